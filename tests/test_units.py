import sqlite3

import pytest
from pyspark.sql import functions as F

from scriptorium import api
from scriptorium.functions import arrow, dates, text
from scriptorium.operators import blocks, registry, search
from scriptorium.operators.nearest import nearest
from scriptorium.operators.rank import global_rank
from scriptorium.plans import registry as plans
from scriptorium.plans.filters import page
from scriptorium.sources.sqlite import SqliteSource

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_partial_dates(spark):
    for raw, want in {"2026": "2026", "2026-00-00": "2026", "2026-04-00": "2026-04", "2024-02-30": "2024-02-30", "2024-2-9": "2024-02-09", "2024-13-01": "2024-13-01", "soon": "soon"}.items():
        assert one(spark, dates.partial_date(F.lit(raw))) == want


def test_years(spark):
    assert [one(spark, dates.year_in(F.lit(t))) for t in ("c. 1987", "120013", "20201", "1899 or 2004")] == [1987, None, None, 2004]


def test_sentences_and_chunks(spark):
    s = one(spark, text.sentences(F.lit("Dr. Berg came, e.g. by bus. It rained! 3 hours went by. so it was")))
    assert s == ["Dr. Berg came, e.g. by bus.", "It rained!", "3 hours went by. so it was"]
    s = one(spark, text.sentences(F.lit("See e.g. The one. Prof. Ono et al. 2 left.  \n Äh? Ébène! ")))
    assert s == ["See e.g. The one.", "Prof. Ono et al. 2 left.", "Äh?", "Ébène!"]
    c = one(spark, arrow.chunks(F.lit(None).cast("array<string>")))
    assert c is None
    c = one(spark, arrow.chunks(F.array(*[F.lit("a" * 300 + ".") for _ in range(7)])))
    assert all(len(x) <= 900 for x in c) and " ".join(c) == " ".join(["a" * 300 + "."] * 7)
    long = " ".join(["word"] * 500)
    assert all(len(x) <= 900 for x in arrow.pack_sentences([long])) and " ".join(arrow.pack_sentences([long])) == long
    assert arrow.pack_sentences(["x" * 1000]) == ["x" * 900, "x" * 100] and arrow.pack_sentences(["One.", long], whole=True) == ["One.", long]
    assert arrow.pack_sentences(["ab", "cd", "efg"], most=5) == ["ab cd", "efg"] and arrow.pack_sentences(["", "a"]) == ["a"]


def test_surnames(spark):
    assert [one(spark, text.surname(F.lit(n))) for n in ("Berg, Anna", "Jan van Dyk", "Ada Lovelace", "Plato", " Jean  du Pont ", "Maria De la Cruz", "van Dyk", "Ann\tVon Au", "")] == ["Berg", "van Dyk", "Lovelace", "Plato", "Pont", "la Cruz", "van Dyk", "Von Au", ""]


def test_front_matter_only_at_the_start(spark):
    assert one(spark, text.without_front_matter(F.lit("---\na: 1\n---\nbody\n---\nb\n---\n"))) == "body\n---\nb\n---\n"


def test_continuations(spark):
    lines = F.array(*[F.lit(x) for x in ("A sentence that", "goes on here.", "Next (with", "more) text", "New: one")])
    assert one(spark, blocks.merge_continuations(lines)) == ["A sentence that goes on here.", "Next (with more) text", "New: one"]


def test_pages(spark):
    df = spark.range(1000)
    assert [page(df, n, 0).count() for n in (-5, float("nan"), 2.9, 10**9)] == [1, 50, 2, 500]
    assert page(df, 5, -3).first().id == 0


def test_global_rank(spark):
    got = global_rank(spark.range(500).select((F.col("id") * 37 % 500).alias("k")), ["k"], "r").collect()
    assert all(x.r == x.k + 1 for x in got) and len(got) == 500


def test_bm25_formula(spark, tmp_path):
    import math

    docs = spark.createDataFrame([(1, "red", "blue blue"), (2, "green", "red"), (3, "x", "y z w")], "id int, title string, body string")
    search.write_index(docs, str(tmp_path))
    got = {r.id: r.score for r in search.bm25(spark, str(tmp_path), "red").collect()}
    idf = max(math.log((3 - 2 + 0.5) / (2 + 0.5)), 0) or 1e-6
    part = lambda tf, n: -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 3))
    assert got == pytest.approx({1: part(5, 3), 2: part(1, 2)})
    assert search.bm25(spark, str(tmp_path), "?!").count() == 0


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE items(k INTEGER, name TEXT)")
        con.executemany("INSERT INTO items VALUES (?, ?)", [(i, f"n{i}") for i in range(20)])
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite_table").options(path=path, table="items", partitions="3").schema("k long, name string").load()
    assert df.count() == 20 and df.agg(F.sum("k")).first()[0] == 190


def test_registry(spark):
    registry.register("upper", lambda df: df.withColumn("u", F.upper("name")))
    with pytest.raises(ValueError):
        registry.register("none", None)
    with pytest.raises(KeyError):
        registry.get("absent")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, n int")
    got = registry.classify_once(rows, "name", lambda df: df.select("name", F.upper("name").alias("label")))
    assert sorted((r.n, r.label) for r in got.collect()) == [(1, "A"), (2, "A"), (3, "B")]


def test_api(spark):
    assert api.article(spark, SF, 3).first().id == 3
    with pytest.raises(KeyError):
        api.article(spark, SF, -1)
    found = api.search(spark, SF, "the reation", 5).collect()
    assert len(found) == 5 and [r.score for r in found] == sorted(r.score for r in found)
    assert api.library(spark, SF, "the", 7).count() == 7 and api.status(spark, SF).first().labelled > 0


def test_whole_texts(spark, tmp_path):
    texts = ["red, green; " + "word " * 60 + "end.", "red, green; blue", "=1" + "x" * 50, "Red, green. Blue, grey", "red · green · blue"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = plans.QUERIES["t13_keyword_list_whole"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.keywords) for r in rows) == [(0, False), (1, True), (2, False), (3, False), (4, True)]
    cells = {r.doc_id: r.cell for r in plans.QUERIES["s14_csv_guard_whole"](spark, str(tmp_path)).collect()}
    assert cells == {k: "'" + t if t[0] == "=" else t for k, t in enumerate(texts)}


def test_paragraphs_of_all_documents(spark, tmp_path):
    page = "Journal of Tests {n}\nPart {w}.\n\nA well-\nknown fact, soft­\nly told.\n\n* A note that goes\non and ends.\nMore text.\nPublished by Us\n2.1. Data. The rows.\n\nEnd {w}.\nPage {n}"
    texts = ["One.\n\nTwo\nlines.\n\n\nThree.", "\f".join(page.format(n=n, w=w) for n, w in enumerate("abc", 1)), "one line", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted((r.doc_id, r.k, r.block) for r in plans.QUERIES["x1_paragraphs"](spark, str(tmp_path)).collect())
    body = [b for w in "abc" for b in (f"Part {w}.", "A well-known fact, softly told.", "More text.", "2.1. Data", "The rows.", f"End {w}.")]
    assert rows == [(0, k, b) for k, b in enumerate(("One.", "Two lines.", "Three."))] + [(1, k, b) for k, b in enumerate(body)] + [(2, 0, "one line")]
    left = [(r.text, r.reason) for r in plans.QUERIES["x1_omissions"](spark, str(tmp_path)).orderBy("doc_id", "k").collect()]
    edge, note = "repeated-page-edge", "footnote"
    assert left == [x for n in "123" for x in ((f"Journal of Tests {n}", edge), ("* A note that goes", note), ("on and ends.", note), ("Published by Us", "publisher-or-contact-furniture"), (f"Page {n}", edge))]


def test_all_alike_titles(spark, tmp_path, monkeypatch):
    import difflib

    from scriptorium.operators import titles

    monkeypatch.setattr(titles, "SIDE", 3)
    body = "the long study of many rivers and lakes in the north of a cold country"
    texts = ["A first " + body, "A first word on something else", "Other start: " + body, "other START " + body, "Other starts " + body + "!", "ß" * 80, "ß" * 79 + "s", "?!", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r["with"]): (r.ratio, r.strict) for r in plans.QUERIES["g1_fuzzy_titles"](spark, str(tmp_path)).collect()}
    plain = {k: " ".join("".join(c if c.isalnum() else " " for c in t[:80].casefold()).split()) for k, t in enumerate(texts)}
    ids = {k: min(j for j in plain if plain[j] == p) for k, p in plain.items() if p}
    want = {(k, c): 1.0 for k, c in ids.items() if k != c}
    firsts = sorted(set(ids.values()))
    want |= {(a, b): r for a in firsts for b in firsts if b < a and (r := difflib.SequenceMatcher(None, plain[a], plain[b], autojunk=False).ratio()) >= 0.65}
    assert got == {k: (r, r >= 0.94) for k, r in want.items()}
    assert {(3, 2), (2, 0), (4, 2), (6, 5)} <= set(got)


def test_alike_titles_without_difflib():
    import difflib
    import random

    import pandas as pd

    from scriptorium.operators import titles

    rng = random.Random(5)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    real = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False)
    for _ in range(1500):
        a, b = (word("abcdefgh"[: rng.choice((1, 2, 4, 8))], rng.choice((4, 30, 130))) for _ in "ab")
        assert titles.matched(a, b) == sum(m.size for m in real(a, b).get_matching_blocks()), (a, b)
    # long ones, more characters than kinds, and syllables that share nearly all of their letters
    wide = [chr(0x4E00 + k) for k in range(400)]
    texts = [word(wide, 90) for _ in range(20)] + ["ss" * 80, "ss" * 79 + "st"] + ["x" * 70 + word("ab c", 60) for _ in range(20)]
    texts += [" ".join(word("etaoin", 9) for _ in range(12)) for _ in range(60)] + ["".join(wide[:50]) + word(wide, 20) for _ in range(5)]
    rows = pd.DataFrame({"plain": list(dict.fromkeys(texts))}).reset_index(names="id").sample(frac=1, random_state=1).reset_index(drop=True)
    text = dict(zip(rows["id"], rows["plain"], strict=True))
    want = {(a, b): r for a in text for b in text if b < a and (r := real(text[a], text[b]).ratio()) >= 0.65}
    assert sorted(titles._alike(rows, rows, True, 0.65)) == sorted((a, b, r) for (a, b), r in want.items())
    halves = rows[:40].reset_index(drop=True), rows[40:].reset_index(drop=True)
    ids = set(halves[0]["id"])
    assert sorted(titles._alike(*halves, False, 0.65)) == sorted((a, b, r) for (a, b), r in want.items() if (a in ids) != (b in ids))
    assert len(want) > 100


def test_rules_read_the_documents(spark, tmp_path):
    texts = {
        "Body.\nLicensed under CC BY 4.0.": "CC BY 4.0", "Body.\nLicensed under CC BY-NC 4.0.": None, "See https://creativecommons.\norg/licenses/ by/4.0/": "CC BY 4.0",
        "Under the Creative Commons Attribution 4.0\nInternational License.": "CC BY 4.0", "Creative Commons Attribution-Non Commercial 4.0 License, CC BY 4.0": None, "This is CC0.": "CC0", "MIT License": None,
        "### A part\nplain\n Conclusion \n2.1. Data and scope. The rows are here.\n\n3. " + "word " * 15 + "end. Body": None,
    }
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.licence for r in run("t22_licence_text")} == dict(enumerate(texts.values()))
    last = len(texts) - 1
    assert [r.level for r in sorted(run("t11_heading_lines"), key=lambda r: r.k) if r.doc_id == last] == [3, None, 2, 3, None, 2]  # one rule for all headings: a number and at most 140 characters
    parts = {r.k: r.parts for r in run("t12_heading_lines") if r.doc_id == last}
    assert parts[3] == ["2.1. Data and scope", "The rows are here."] and all(len(p) == 1 for k, p in parts.items() if k != 3) and len(parts) == 6


def test_blocks_by_ordered_rules(spark, tmp_path):
    text = "A plain line.\n\nTable 2: rows $$$ here\n\nThis figure shows it.\n\n1 2 3 4 5 6 7 8 9 10 11 12\n\nMore %%% text.\n\nReferences\n\nTable 3. A late one\n\nTail."
    spark.createDataFrame([(0, text), (1, "Only this.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = plans.QUERIES["x2_blocks"](spark, str(tmp_path)).orderBy("doc_id", "k").collect()
    tail = "reference-section"
    assert [r.omission_reason for r in rows] == [None, "table-or-figure-caption", "table-or-figure-note", "probable-table-grid", None, tail, tail, tail, None]
    assert all(r.included == (r.omission_reason is None) for r in rows)


def test_reference_tail(spark, tmp_path):
    tail = ["Body.", "3. Berg A. Early.", "Text.", "8. Dyk B. One.", "more", "9. Falk C. Two.", "14. Holm D. Three.", "End."]
    apart = ["1. Berg A. One.", "7. Dyk B. Far.", "2. Falk C. Two.", "1. Holm D. Low."]
    rows = [(1, k, t) for k, t in enumerate(tail)] + [(2, k, t) for k, t in enumerate(apart)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = plans.QUERIES["w8_reference_tail"](spark, str(tmp_path)).orderBy("conv_id", "turn").collect()
    assert [r.kept for r in got] == [True] + [False] * 7 + [True] * 4


def test_search_folds_letters_and_reads_its_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Æble", "Læring på norsk"), (2, "Été", "l'été à la plage, LÆRINGEN"), (3, "日本語", "naïve ΣΟΦΟΣ x1"), (4, None, "")], "id int, title string, body string")
    assert search.query_words("læring*, \"ÉTÉ\" OR x_1") == ["læring", "ete", "or", "x", "1"]
    path = str(tmp_path / "index")
    search.write_index(docs, path)
    assert [r.id for r in search.bm25(spark, path, "ete").collect()] == [2]
    assert sorted(r.id for r in search.prefix_and(spark, path, "læring").collect()) == [1, 2]
    assert sorted(r.id for r in search.prefix_and(spark, path, "lær nor").collect()) == [1]
    assert search.prefix_and(spark, path, "...").count() == search.bm25(spark, path, "").count() == 0
    assert [r.id for r in search.bm25(spark, path, "NAIVE").collect()] == [3]
    hit = search.bm25(spark, path, "norsk")
    assert "EqualTo(term,norsk)" in hit._jdf.queryExecution().toString()  # among the pushed filters


def test_index_is_written_again_when_the_table_changes(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = lambda t: spark.createDataFrame([(1, t, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(path)
    rows("alpha beta")
    first = search.stored_index(spark, str(tmp_path))
    assert search.stored_index(spark, str(tmp_path)) == first and search.bm25(spark, first, "alpha").count() == 1
    rows("gamma delta")
    second = search.stored_index(spark, str(tmp_path))
    assert second != first and search.bm25(spark, second, "alpha").count() == 0 and search.bm25(spark, second, "gamma").count() == 1


def test_git_blob_id(spark):
    assert one(spark, text.blob_id(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, text.blob_id(F.lit(""))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


def test_reservations_leave_room_for_what_still_fits(spark):
    rows = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, 40), ("a", 4, 1), ("b", 1, 101), ("b", 2, 100), ("c", 1, None)], "source string, doc_id long, n_chars long")
    got = {(r.source, r.doc_id): r.accepted for r in arrow.reserve(rows, "source", "doc_id", "n_chars", 100).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("a", 4): False, ("b", 1): False, ("b", 2): True, ("c", 1): True}


def test_global_rank_of_more_rows_than_are_sampled(spark):
    """Bounds of ranges are sampled; ranks must hold whatever they are."""
    n = 200_000
    got = global_rank(spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.lit("x" * 20).alias("other")), ["k"], "r")
    assert got.where("r <> k + 1").count() == 0 and got.count() == n


def test_nearest_equals_all_pairs(spark):
    import random

    rnd = random.Random(5)
    place = lambda: rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-5, 5)), 1e6])
    left = [(k, rnd.randint(0, 3), place()) for k in range(200)] + [(200, 0, None), (201, None, 1.0), (202, 9, 1.0)]
    right = [(rnd.randint(0, 2), place(), k) for k in range(150)] + [(0, None, 900), (None, 1.0, 901)]
    l, r = spark.createDataFrame(left, "k int, group int, at double"), spark.createDataFrame(right, "group int, at double, id int")
    got = {(x["group"], x["at"]): x["nearest"] for x in nearest(l, r, 7.0).collect()}
    want = {}
    for _, g, a in left:
        near = [(abs(b - a), i) for h, b, i in right if h == g and None not in (a, b, g)]
        if near:
            want[g, a] = min(near)[1]
    assert got == want


ABSTRACT = "We measured how long the rain falls on the old roofs of nine towns. " * 5


def test_inferred_abstracts(spark, tmp_path):
    body = ABSTRACT.strip()
    pages = [f"A title\nAnna Berg\nABSTRACT\n{body[:67]}\n{body[68:]}\nKeywords: rain, roofs\n1. Introduction\nMore.", f"Abstract\n{body}\n\nIntroduction\nMore.\nSummary\n{body}", "Abstract\nToo short. And more.", "no heading " * 60, f"Summary\n{body}", None, f"Abstract\n{body} and no end"]
    spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.abstract for r in plans.QUERIES["x3_inferred_abstract"](spark, str(tmp_path)).collect()}
    assert got == {0: body, 1: body, 2: None, 4: body, 6: None}


def test_licences_of_a_bibliography_do_not_count(spark):
    of = lambda t: one(spark, text.licence_in(F.lit(t)))
    assert of("Words.\nOpen Access This article is licensed under a Creative Commons Attribution 4.0 International License.") == "CC BY 4.0"
    assert of("Words.\nThis work is licensed under a Creative Commons Attribution Interna-\ntional 4.0 License.") == "CC BY 4.0"
    assert of("Words.\nReferences: Smith. Open data under CC BY 4.0.") is None
    assert of("Words.\nReferences\nSmith. Open data under CC BY 4.0.\nThis paper is published under https://creativecommons.org/licenses/\nby/4.0/.") == "CC BY 4.0"
    assert of("This article is licensed under Creative Commons Attribution-NonCommercial-NoDerivatives 4.0. References mention CC BY 4.0.") is None
    assert of("Data: CC0 1.0") == "CC0" and of("") is None and of("under CC BY-NC 4.0") is None


def test_paragraph_states_carry_forward(spark):
    """Footnotes over several lines, headings inside and outside of open text, line ends of every kind, repeated ids."""
    rows = [(1, "Abstract\nText that is\nMethods\nopen.\n\nMethods\n† note begins\nnote goes on\n\n3. Results\nSignificance:\nmore."), (1, "a\r\nb\rc\u2028d"), (None, "x"), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from scriptorium.operators import paragraphs

    lines = paragraphs.classified(df, "doc_id", "text")
    got = sorted(((r.id, r.row), r.k, r.block) for r in paragraphs.blocks(lines).collect() if r.id is not None)
    first = [b for (i, row), _, b in got if row == got[0][0][1]]
    assert first == ["Abstract", "Text that is Methods open.", "Methods", "3. Results", "Significance:", "more."]
    assert [b for (i, row), _, b in got if row != got[0][0][1]] == ["a b c d"]
    assert [(r.text, r.reason) for r in paragraphs.omissions(lines).orderBy("row", "k").collect()] == [("† note begins", "footnote"), ("note goes on", "footnote")]


def test_labels_votes_and_names(spark):
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    assert [one(spark, text.label(names(*n))) for n in (["Berg, Anna"], ["Ada Lovelace", "Jan van Dyk"], ["A B", "C D", "E F"])] == ["Berg", "Lovelace & van Dyk", "B et al."]
    vote = lambda **k: one(spark, text.voted({a: F.lit(n) for a, n in k.items()}))
    assert [vote(en=20, de=23, fr=0), vote(en=20, de=24, fr=24), vote(en=0, de=0, fr=0), vote(en=0, de=0, fr=1)] == ["en", "de", "en", "fr"]
    name = lambda c: one(spark, text.file_part(F.lit(c)))
    assert name("ж" * 180) == "ж" * 120 and name("雨" * 200) == "雨" * 80 and name("a" * 200) == "a" * 180 and name(" . ") == "document" and name("a:b—c") == "a - b - c"


def test_queries_without_sql_on_known_rows(spark, tmp_path):
    page = '<html><head><title>T</title><meta name="citation_author" content="C"></head><body><article><h1>One</h1><p>A &amp; <b>b</b></p><ul><li>x</li></ul><nav>no</nav></article>out</body></html>'
    spark.createDataFrame([(1, "http://a.b/", page), (2, None, None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "ﬁrst line ( a ) .", "src"), (2, "é" * 300, None)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r[0]: r[1] for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("s11_article_markdown") == {1: "## One\n\nA & b\n\n- x", 2: ""}
    assert run("t6_abstracts") == {1: "T One A & b x no out", 2: ""}
    assert run("c11_citation_tags")[1] == '{"citation_author":["A","B","C"]}'
    assert run("t1_nfkc") == {1: "first line (a).", 2: "é" * 300}
    name = run("t30_readable_name")
    assert name[1] == "2025 — ﬁrst line ( a ) . — src" and len(name[2].encode()) in (234, 235)


def test_substring_search_gives_all_hits(spark):
    from scriptorium.operators import search

    rows = spark.createDataFrame([(k, "Src", "x" * 150 + "Idiot" + "y" * 600) for k in range(70)] + [(99, "src", "none")], "doc_id long, source string, text string")
    got = search.substring_and(rows, "idiot src", ["source", "text"]).collect()
    assert sorted(r.doc_id for r in got) == list(range(70))
    assert {(r.snippet, r.total) for r in got} == {("x" * 100 + "Idiot" + "y" * 395, 70)}


@pytest.mark.parametrize(("name", "rows"), [("f7_substring_and", 45), ("f8_substring_and_remote", 45)])
def test_substring_queries_give_all_hits(spark, tmp_path, name, rows):
    spark.createDataFrame([(k, "https://a.org/", "<p>article of spam") for k in range(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, "src1", "an idiot") for k in range(rows)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert plans.QUERIES[name](spark, str(tmp_path)).count() == rows
