"""Secret scan: fixed patterns, and a battery of randomness tests.

DataFrame functions only. The base patterns give spans of known shapes. The
method adds spans of kind ``random``: long runs of coding characters. Base spans
are cut out of a run, and what is left of it is a run if it is long enough. For
every run an alphabet is inferred (digits, hexadecimal, letters of one or both
cases, base 32, base 36 or base 64) and three tests of uniform randomness are
made: chi-squared over the alphabet, the number of runs above and below its
middle, and the serial correlation of neighbours. Fisher's method joins the
p-values; a run that is not like random at the level ``UNLIKE`` is no secret.

What looks random may still be text, most of all if it is short. So each other
run has a p-value under text as well: how far its letters favour the uniform
alphabet over the letters of European languages (``SHARES``, with a tenth of
noise), in standard deviations of what so many letters of text would give. Runs
whose text p-value stands the Benjamini-Hochberg step-up over all runs of the
corpus of their alphabet and length class are spans: the expected share of text
among the spans reported stays below ``RATE``. P-values are counted in classes
of a quarter of a power of ten, a table of fixed size. Digits alone are hardly
unlike the digits of text, so they are seldom reported.

Defined results: null text is empty; documents without spans have the digest
of the empty string; repeated rows are scanned each; offsets count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, documents, sha256_hex, stored

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# Runs are maximal, so asking for 32 keeps just those that reach 32.
HEX = r"[0-9a-f]{32,}"
CODED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

LONG = 20

# Hundredths of letters in English, German, French and Spanish text.
SHARES = {
    "a": 8.5, "b": 1.4, "c": 3.5, "d": 4.5, "e": 14.5, "f": 1.4, "g": 1.8, "h": 3.0, "i": 7.4, "j": 0.3, "k": 0.6, "l": 5.0, "m": 3.0,
    "n": 8.0, "o": 6.0, "p": 2.5, "q": 0.4, "r": 6.7, "s": 7.1, "t": 6.5, "u": 4.5, "v": 1.4, "w": 0.8, "x": 0.2, "y": 0.8, "z": 0.4,
}
#: Shares of capitals (of letters), digits, and hyphens and slashes in names and paths.
CAPITAL, DIGIT, JOINT = 0.06, 0.02, 0.05

#: (name, pattern of the run, letters in order); the first that fits counts, and
#: one without capitals takes both cases as equal.
ALPHABETS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("letters", "^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("mixed", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base32", "^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
RATE, UNLIKE = 0.01, 1e-3
_STEPS = 80


def found(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, stop, what>> of the leftmost matches that do not
    overlap; those whose group is shorter than ``least`` go."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("before"), whole.alias("what"), part.alias("part"))

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        stop = start + F.length(x["what"])
        one = F.when(F.length(x["part"]) >= least, F.array(F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), x["what"].alias("what")))).otherwise(none)
        return F.struct(stop.cast("long").alias("at"), F.concat(acc["spans"], one).alias("spans"))

    none = F.array().cast("array<struct<start:bigint,stop:bigint,what:string>>")
    walked = F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), walked).otherwise(none)


def favours(letters: str) -> tuple[list[float], float, float]:
    """For each letter how much it favours the uniform alphabet over text, and
    mean and standard deviation of that in text."""

    def share(c: str) -> float:
        if c.isdigit():
            return DIGIT / 10
        if not c.isalpha():
            return JOINT
        return SHARES[c.lower()] / 100 * (CAPITAL if c.isupper() else 1 - CAPITAL)

    raw = [share(c) for c in letters]
    text = [0.9 * r / sum(raw) + 0.1 / len(letters) for r in raw]
    gain = [-math.log(len(letters) * t) for t in text]
    mean = sum(t * g for t, g in zip(text, gain, strict=True))
    # Letters of words depend on each other, so sums vary more than those of single draws.
    return gain, mean, max(1e-9, math.sqrt(1.5 * sum(t * (g - mean) ** 2 for t, g in zip(text, gain, strict=True))))


def _tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (error below 1e-7)."""
    t = 1 / (1 + 0.3275911 * F.abs(z) / math.sqrt(2))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-z * z / 2)
    return F.greatest(F.lit(1e-30), F.when(z >= 0, half).otherwise(1 - half))


def battery(token: Column, letters: Column, caseless: Column, gain: Column) -> Column:
    """Struct of two p-values of a run: ``random``, the joint one under uniform
    draws from ``letters``, and ``text``, that under letters of text. ``gain``:
    what each letter favours, with mean and deviation in text."""
    plain = F.rtrim(F.translate(token, "-_", "+/"), F.lit("="))
    plain = F.when(caseless, F.lower(plain)).otherwise(plain)
    values = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.greatest(F.lit(0), F.instr(letters, c) - 1).cast("double"))

    def once(value: Column, use) -> Column:
        """``use`` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def judged(s):
        v, n, k, mean = s["v"], s["n"], s["k"], s["mean"]
        chi = F.aggregate(F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda c: F.size(F.filter(v, lambda x: x == c)).cast("double")), F.lit(0.0), lambda a, c: a + (c - n / k) * (c - n / k) / (n / k))
        df = k - 1.0
        p_chi = _tail((F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        pairs = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("a"), F.slice(v, 2, F.size(v) - 1).alias("b"))
        high = F.size(F.filter(v, lambda x: x >= k / 2)).cast("double")
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2)))
        expected = 1 + 2 * high * (n - high) / n
        variance = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = F.when(variance > 0, 2 * _tail(F.abs(runs - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9))))).otherwise(F.lit(1e-6))
        spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        together = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        p_serial = F.when(spread > 0, 2 * _tail(F.abs((together / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))).otherwise(F.lit(1e-6))
        half = -(F.log(p_chi) + F.log(F.least(p_runs, F.lit(1.0))) + F.log(F.least(p_serial, F.lit(1.0))))
        joint = once(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        favour = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.element_at(gain["of"], x.cast("int") + 1))
        text = _tail((favour - n * gain["mean"]) / (gain["deviation"] * F.sqrt(n)))
        return F.struct(joint.alias("random"), text.alias("text"))

    # A run of padding alone counts as two equal letters.
    whole = F.when(F.size(values) > 1, values).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    bound = once(whole, lambda v: F.struct(v.alias("v"), F.size(v).cast("double").alias("n"), F.length(letters).cast("double").alias("k"), (total(v) / F.size(v)).alias("mean")))
    return once(bound, judged)


def rests(run: Column, base: Column) -> Column:
    """What ``base``, in order of start, leaves of a run: pieces of ``LONG``."""

    def upto(acc, end):
        start, size = acc["at"], end - acc["at"]
        what = F.substring(run["what"], (start - run["start"] + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))
        piece = F.struct(start.alias("start"), end.alias("stop"), what.alias("what"))
        return F.when(size >= LONG, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])

    none = F.array().cast("array<struct<start:bigint,stop:bigint,what:string>>")
    meets = F.filter(base, lambda b: (b["start"] < run["stop"]) & (run["start"] < b["stop"]))
    step = lambda acc, b: F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), upto(acc, b["start"]).alias("out"))
    return F.aggregate(meets, F.struct(run["start"].alias("at"), none.alias("out")), step, lambda acc: upto(acc, run["stop"]))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, stop, class, step>>: coded runs outside the spans in
    ``base`` with their class (alphabet and length) and the step of their text p-value
    (0 for those that are not like random)."""
    coded = F.flatten(F.transform(found(text, CODED), lambda s: rests(s, base)))

    def judged(s):
        # A separator between a run and a span that was cut off says nothing of the alphabet.
        bare = F.regexp_replace(s["what"], "^[+/_=-]+|[+/_-]+$", "")
        token, size = F.when(bare.rlike("^[A-Za-z0-9]+=*$"), bare).otherwise(s["what"]), F.least(F.floor(F.log2((s["stop"] - s["start"]) / 10.0) * 2), F.lit(15)).cast("int")
        last = len(ALPHABETS) - 1
        gains = []
        for _, _, letters_ in ALPHABETS:
            gain, mean, deviation = favours(letters_)
            gains.append(F.struct(F.array(*map(F.lit, gain)).alias("of"), F.lit(mean).alias("mean"), F.lit(deviation).alias("deviation")))
        kind, letters, gain = F.lit(last), F.lit(ALPHABETS[last][2]), gains[last]
        for i in reversed(range(last)):
            fits = token.rlike(ALPHABETS[i][1])
            kind, letters, gain = F.when(fits, F.lit(i)).otherwise(kind), F.when(fits, F.lit(ALPHABETS[i][2])).otherwise(letters), F.when(fits, gains[i]).otherwise(gain)
        p = F.element_at(F.transform(F.array(battery(token, letters, letters == F.lower(letters), gain)), lambda p: F.when(p["random"] >= UNLIKE, p["text"]).otherwise(1.0)), 1)
        step = F.least(F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(_STEPS - 1)).cast("int")
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), (kind * 16 + size).alias("class"), F.greatest(step, F.lit(0)).alias("step"))

    return F.transform(coded, judged)


def limits(runs: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each class the lowest step whose runs are rejected as text.
    ``runs`` has a column ``runs``; what is collected has a fixed size."""
    counted = runs.select(F.explode("runs").alias("r")).groupBy(F.col("r.class").alias("class"), F.col("r.step").alias("step")).count().collect()
    out = {}
    for kind in {r["class"] for r in counted}:
        by_step = {r["step"]: r["count"] for r in counted if r["class"] == kind}
        total, above = sum(by_step.values()), 0
        for step in sorted(by_step, reverse=True):
            above += by_step[step]
            if 10 ** (-step / 4) <= rate * above / total:  # the step's largest p-value
                out[kind] = step
    return out


def random_spans(runs: Column, base: Column, rejected: dict[int, int]) -> Column:
    """Runs that are like random, unlike text, and meet no base span."""
    cut = F.create_map(*[F.lit(x) for pair in rejected.items() for x in pair]) if rejected else None

    def stays(r):
        if cut is None:
            return F.lit(False)
        lone = ~F.exists(base, lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"]))
        return lone & (r["step"] >= F.coalesce(F.try_element_at(cut, r["class"]), F.lit(_STEPS)))

    return F.transform(F.filter(runs, stays), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["stop"].alias("stop")))


def base_spans(text: Column) -> list[Column]:
    return [found(text, ASSIGN, 8, 2), found(text, ACCESS, 16), found(text, HEX)]


def _ordered(spans: list[Column]) -> Column:
    """array<struct<start, kind, stop>> in order of start, then kind."""

    def tagged(kind: int, of: Column) -> Column:
        return F.transform(of, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))

    return F.array_sort(F.concat(*[tagged(k, s) for k, s in enumerate(spans)]))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep``, base spans, their numbers and candidate runs."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(*keep, F.col("text").alias("_text"))
    rows = rows.select(*keep, "_text", *[s.alias(f"_{k}") for k, s in zip(KINDS, base_spans(text), strict=False)])
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    rows = rows.select(*keep, "_text", *counts, _ordered([F.col(f"_{k}") for k in KINDS[:3]]).alias("base"))
    return rows.select(*keep, *[f"n_{k}" for k in KINDS[:3]], "base", candidates(text, F.col("base")).alias("runs"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, scanned(documents(spark, sf_dir), ["doc_id"]))
    added = random_spans(F.col("runs"), F.col("base"), limits(rows))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", sha256_hex(_written(F.col("base"))).alias("base_sha256"), _written(F.array_sort(F.concat("base", added))).alias("spans"))


def redacted(spark: SparkSession, docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Pipeline stage: every span of a text is replaced by ``mark``. Spans are
    found once and stored beside the rows. Null and empty texts stay as they
    are, repeated rows are scanned each; other columns may have any name and
    type."""
    names = [f"`{c}`" for c in docs.columns]
    found = stored(spark, scanned(boxed(docs, text=F.col("text")), ["row"]))
    text = F.col("row.text")
    spans = found.withColumn("spans", F.array_sort(F.concat("base", random_spans(F.col("runs"), F.col("base"), limits(found)))))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.size("spans") > 0, whole).otherwise(text)
    return spans.select(*[new.alias("text") if n == "`text`" else F.col(f"row.{n}") for n in names])
