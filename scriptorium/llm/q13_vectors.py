"""op13: a code of 16 entry numbers for every vector."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector_codes as V
from ._common import table

PARAMS = V.Params(parts=16, entries=64, rounds=2, scale=256)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = V.encode(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", PARAMS)
    rows = V.with_label_error(coded.rows)
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


def _assigned(books: str) -> str:
    """Every part beside its nearest entry: the distance leads, the lower entry decides ties."""
    far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    return f"SELECT r, part, any_value(x) AS x, min({far} * 256 + entry) AS best FROM x JOIN {books} USING (part) GROUP BY r, part"


def _moved(books: str, assigned: str) -> str:
    mean = f"SELECT part, entry, list(m ORDER BY place) AS m FROM (SELECT part, best % 256 AS entry, place, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM (SELECT part, best, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM {assigned}) GROUP BY ALL) GROUP BY ALL"
    return f"SELECT b.part, b.entry, coalesce(m, c) AS c FROM {books} b LEFT JOIN ({mean}) n ON b.part = n.part AND b.entry = n.entry"


def sql(p: V.Params = PARAMS) -> str:
    """The rounds written out; every vector must have the same length, which the parts divide."""
    steps = [
        f"v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda e: CAST(floor({p.scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"x AS (SELECT r, part, v[part * (len(v) // {p.parts}) + 1 : (part + 1) * (len(v) // {p.parts})] AS x FROM v, range({p.parts}) g(part))",
        f"b0 AS (SELECT part, r - 1 AS entry, x AS c FROM x WHERE r <= {p.entries})",
    ]
    for k in range(p.rounds):
        steps += [f"a{k} AS MATERIALIZED ({_assigned(f'b{k}')})", f"b{k + 1} AS MATERIALIZED ({_moved(f'b{k}', f'a{k}')})"]
    last = f"b{p.rounds}"
    steps += [
        f"z AS MATERIALIZED ({_assigned(last)})",
        "e AS (SELECT r, string_agg(format('{:02x}', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM z GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (r), h"


SQL = sql()
