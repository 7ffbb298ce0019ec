import re

from millrace.llm import op03_licences as op


def brute(text):
    text = text or ""
    lines = text.split("\n")
    paragraphs = re.split(r"\n(?:[^A-Za-z0-9\n]*\n)+", text)
    found = [*lines, *re.split(r"[.!?]+[ \t\r\n]+", text), text]
    found += ["\n".join(paragraphs[i : i + k]) for k in (1, 2, 3) for i in range(len(paragraphs) - k + 1)]
    block = []
    for line in [*lines, "x"]:
        if re.match(r"[ \t]*(//|#|\*|/\*|--|;|%|<!--)", line):
            block.append(line)
        elif block:
            found.append("\n".join(block))
            block = []
    hits = []
    for w in {tuple(op.plain_words(u)) for u in found}:
        b = {f"{x} {y}" for x, y in zip(w, w[1:], strict=False)}
        if b:
            score, licence = min((-2.0 * len(b & set(t)) / (len(b) + len(t)), k) for k, t in op.templates())
            if -score >= op.LEAST:
                hits.append((-score, licence))
    return len(hits), ",".join(sorted({k for _, k in hits})), max((s for s, _ in hits), default=0.0)


def test_against_brute_force(spark):
    mit = op.TEXTS["MIT"]
    words = mit.split()
    docs = [
        None, "", "one", "Released under the MIT License.", "text\nLicensed under CC BY-NC 4.0.\nmore text here", mit, "\n".join(words[i : i + 9] and " ".join(words[i : i + 9]) for i in range(0, len(words), 9)),
        "This WORK is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.", " ".join(words[:100]), "x " * 5000, "licensed under é the mit license", op.TEXTS["ISC"] + " a few words more at the end", "\n\n\n",
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)] + [(3, docs[3], "z")], "doc_id long, text string, licences string")
    got = {r.doc_id: tuple(r)[1:] for r in op.scan(df, ["doc_id"]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(docs)}
    assert sum(v[0] for v in got.values()) >= 9


def test_bounds_lose_nothing():
    for m in range(1, 60):
        for n in range(1, 60):
            if 2 * min(m, n) / (m + n) >= op.LEAST:
                low, high = op.bounds(m)
                assert low - 1e-9 <= n <= high + 1e-9


def test_full_texts(spark):
    """Full texts, as a line between others and wrapped over the whole document."""
    wrapped = lambda text: "\n".join(" ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    names = ["AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    docs = [text for k in names for text in ("int a;\n" + op.TEXTS[k] + "\nint b;", wrapped(op.TEXTS[k]))]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in op.scan(df, ["doc_id"]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(docs)}
    assert all(k in got[2 * i + j][1].split(",") for i, k in enumerate(names) for j in (0, 1))


def test_parts_of_texts(spark, tmp_path):
    """Comment headers, paragraphs between others, notices inside lines, in the query and its SQL."""
    import oracle

    wrapped = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    mit = op.TEXTS["MIT"]
    half = len(mit) // 2
    docs = [
        wrapped(mit, "// ") + "\nint main() { return 0; }\n" * 40, "/*\n" + wrapped(mit[:half], " * ") + "\n *\n" + wrapped(mit[half:], " * ") + "\n */\nint x;\n" * 2 + "y = 1\n" * 300,
        "words before\n" * 200 + "\n" + wrapped(op.TEXTS["ISC"], "") + "\n\n" + "words after\n" * 200, "prose " * 60 + "ends. Released under the MIT License. More " + "prose " * 50,
        "a\n\n" + mit[:half] + "\n  \n" + mit[half:] + "\n\n" + "tail " * 500, "licensed under the mit license\n" * 800, "plain words only\n" * 50, "# " + "x " * 400 + "license",
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op.op3_licences(spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(docs)}
    assert [got[i][1] for i in range(8)] == ["MIT", "MIT", "ISC", "MIT", "MIT", "MIT", "", ""]
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(spark, con, op.op3_licences, op.oracle(), str(tmp_path)) is None


def test_every_match_holds_an_anchor():
    words = set(op.anchors())
    for _, pairs in op.templates():
        without = [p for p in pairs if not words & set(p.split())]
        # All that a unit without anchors can share is too little.
        assert len(without) * (2 - op.LEAST) < len(pairs) * op.LEAST
