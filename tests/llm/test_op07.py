import hashlib
import re

from millrace.llm import op07_decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            v = words(body)
            for i in range(max(1, len(v) - 7) if v else 0):
                part = v[i : i + 8]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit |= set(range(j, j + len(part)))
                        found.add(str(item))
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


LONG = " ".join(f"w{i}" for i in range(30))
DOCS = [(1, None), (2, ""), (3, "One, two-three"), (4, "x " + LONG.upper() + " y one TWO three"), (5, LONG * 3), (6, "w0 w1 w2"), (7, "é one two three ü"), (8, "one two three one two three")]
ITEMS = [(10, "one two three"), (2, " ".join(f"w{i}" for i in range(5, 15))), (3, None), (4, "!!"), (5, "three one"), (5, "three one")]


def test_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (op.MAX_PATTERN_BYTES, 20):
        monkeypatch.setattr(op, "MAX_PATTERN_BYTES", limit)
        rows = op.hits(spark, docs.selectExpr("doc_id AS row", "text"), items).mapInArrow(op._digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").collect()
        assert {r[0]: tuple(r)[1:] for r in rows} == brute(DOCS, ITEMS)


def test_stage_cuts_and_drops(spark):
    docs = spark.createDataFrame([(1, "Keep! One, two THREE. end", "a"), (2, "one two three one", "b"), (3, None, "c"), (4, "clean text", None)], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r.doc_id: r for r in op.without_benchmark(spark, docs, items).collect()}
    assert rows[1].text == "Keep! . end" and 2 not in rows and rows[3].text is None and rows[4].text == "clean text"


def test_items_without_an_id_against_sql(spark, monkeypatch, tmp_path):
    """Their windows cover words and add no item, in the query and in the stage."""
    import oracle

    from millrace.llm import sql

    items = spark.createDataFrame([*ITEMS, (None, "w0 w1 w2"), (None, "one two three"), (None, "é one"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([*DOCS, (9, "say w0 w1 w2 now")], "doc_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    items.toPandas().astype({"item_id": "Int64"}).to_parquet(tmp_path / "benchmark.parquet")
    for limit in (op.MAX_PATTERN_BYTES, 20):
        monkeypatch.setattr(op, "MAX_PATTERN_BYTES", limit)
        assert oracle.compare(spark, oracle.connect(str(tmp_path)), op.op7_decontaminate, sql.OP7, str(tmp_path)) is None
    kept = {r.doc_id: r.text for r in op.without_benchmark(spark, docs, items).collect()}
    assert kept[9] == "say  now"
