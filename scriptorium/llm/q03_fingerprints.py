"""op3: fingerprints of all documents, against their edited texts and their next documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctph
from ._common import table


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctph.compare_with_next(table(spark, sf_dir, "documents"))
    own = F.col("fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", ctph.likeness(own, F.col("edited_fingerprint")).alias("near_edited"), ctph.likeness(own, F.col("next_fingerprint")).alias("near_next"))
