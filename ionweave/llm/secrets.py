"""Secret scan: fixed patterns, and strings that a character Markov model calls random.

Two first-order Markov models over ASCII characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples.  Random are the values that the patterns find and
digests in hexadecimal and base 64; ordinary are the token runs of documents without such values, and
neighbouring words of theirs written as identifiers and paths.  The parts of a token run in which the
log-likelihood ratio of the two models adds up to enough are reported.  All of it is column expressions.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of the base kinds (fixed values), in order of report.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
RANDOM = "random"
KINDS = [*PATTERNS, RANDOM]
MIN_VALUE = 8
#: A maximal run of token characters; the look-behind keeps one start per run.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}+"
THREE_WORDS = r"[A-Za-z]{2,} [A-Za-z]{2,} [A-Za-z]{2,}"
#: Characters of separator lines, which are ordinary.
RULES = "-=_+/"
#: An identifier that is random on purpose and no secret.
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
ALPHABET = 128
FOUND = "array<struct<kind:int,gap:bigint,len:bigint,value:string>>"
PARTS = "array<struct<from:bigint,to:bigint>>"


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.ascii(c))


def _found(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Matches of one kind as structs; ``gap`` is the distance in code points from the match before."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    each = F.transform(zipped, lambda z: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.length(z["gap"]).cast("bigint").alias("gap"),
        F.length(z["whole"]).cast("bigint").alias("len"), z["value"].alias("value")))
    hit = text.contains("AKIA") & text.rlike(pattern) if kind == "access" else text.rlike(pattern)
    return F.when(hit, F.filter(each, lambda z: z["len"].isNotNull())).otherwise(F.array().cast(FOUND))


def _pattern_matches(text: Column, kind: str) -> Column:
    return _found(text, kind, PATTERNS[kind], 2 if kind == "assign" else 0)


def _valid(item) -> Column:
    return (item["kind"] != 0) | (F.length(item["value"]) >= MIN_VALUE)


def _identifiers(text: Column) -> Column:
    """Words next to each other, three at a time, written as identifiers, paths, constants and times, a form for each three in turn."""

    def form(phrase: Column, k: Column) -> Column:
        title = F.initcap(phrase)
        number = F.pmod(F.xxhash64(phrase), F.lit(1000)).cast("string")
        lower = F.lower(phrase)
        two = F.lpad((number.cast("int") % 28 + 1).cast("string"), 2, "0")
        camel = F.concat(F.substring(lower, 1, 1), F.substring(F.replace(title, F.lit(" ")), 2, 1 << 30))
        forms = [F.replace(lower, F.lit(" "), F.lit("_")), F.replace(title, F.lit(" ")), camel,
                 F.concat(F.lit("/"), F.replace(lower, F.lit(" "), F.lit("/"))), F.replace(lower, F.lit(" "), F.lit("-")),
                 F.upper(F.replace(phrase, F.lit(" "), F.lit("_"))), F.concat(F.replace(lower, F.lit(" "), F.lit("_")), number),
                 F.concat(F.replace(lower, F.lit(" "), F.lit("-")), F.lit("="), number),
                 F.concat(F.lit("20"), two, F.lit("-"), two, F.lit("-"), two, F.lit("T"), two)]
        return F.element_at(F.array(*forms), k % len(forms) + 1)

    return F.transform(F.regexp_extract_all(text, F.lit(THREE_WORDS), F.lit(0)), form)


def train(docs: DataFrame, sample_docs: int = 20_000, class_share: float = 0.2) -> list[float]:
    """Log-likelihood ratios random / ordinary for every pair of adjacent ASCII characters, row by row.

    Fitted on about ``sample_docs`` documents drawn by a hash of the id (all, if there are fewer); the
    table has 128 x 128 numbers whatever the input.  Without any sample all ratios are zero.

    Either probability is a mixture: ``class_share`` of it comes from the classes of the two characters (lower case,
    upper case, digit, any other), so that ordinary words in letters that the corpus hardly joins don't look random.
    """
    total = docs.count()
    share = min(1.0, sample_docs / max(total, 1))
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    base = F.concat(*[_pattern_matches(F.col("text"), kind) for kind in PATTERNS])
    drawn = drawn.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256).alias("digest"))
    drawn = drawn.withColumn("base", F.transform(F.filter(base, _valid), lambda b: b["value"]))
    random = F.concat("base", F.array(F.col("digest"), F.base64(F.unhex("digest"))))
    ordinary = F.when(F.size("base") > 0, F.array().cast("array<string>")).otherwise(F.concat(
        F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)), _identifiers(F.col("text")), F.array(*[F.lit(c * 8) for c in RULES])))
    both = F.concat(F.transform(random, lambda v: F.struct(F.lit(True).alias("random"), v.alias("value"))),
                    F.transform(ordinary, lambda v: F.struct(F.lit(False).alias("random"), v.alias("value"))))
    codes = drawn.select(F.explode(both).alias("s")).select("s.random", _codes(F.col("s.value")).alias("c")).filter(F.size("c") > 1)
    pairs = codes.select("random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"),
                                                          F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
    pairs = pairs.filter((F.col("p.a") < ALPHABET) & (F.col("p.b") < ALPHABET))
    counts = pairs.groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()
    seen = {kind: {(r["a"], r["b"]): r["n"] for r in counts if r["random"] == kind} for kind in (True, False)}
    if not seen[True] or not seen[False]:
        return [0.0] * ALPHABET * ALPHABET
    random_p, ordinary_p = (_mixture(seen[kind], class_share) for kind in (True, False))
    return [round(math.log(r / o), 6) for r, o in zip(random_p, ordinary_p)]


def _character_class(c: int) -> int:
    return 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3


def _mixture(seen: dict[tuple[int, int], int], class_share: float) -> list[float]:
    """Probability of the second character after the first, for all pairs; the class part is smoothed by one count."""
    row, moves, leaves = Counter(), Counter(), Counter()
    for (a, b), n in seen.items():
        row[a] += n
        moves[_character_class(a), _character_class(b)] += n
        leaves[_character_class(a)] += n
    size = (26, 26, 10, 4)
    out = []
    for a in range(ALPHABET):
        for b in range(ALPHABET):
            k, m = _character_class(a), _character_class(b)
            by_class = (moves[k, m] + 1) / (leaves[k] + 4) / size[m]
            by_pair = seen.get((a, b), 0) / row[a] if row[a] else by_class
            out.append(class_share * by_class + (1 - class_share) * by_pair)
    return out


def pair_ratios(value: Column, ratios: list[float]) -> Column:
    """The ratio of every pair of adjacent characters; null where one of them isn't ASCII."""
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    codes = _codes(value)
    pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.size(codes), F.lit(1))), lambda a, b: F.when(
        (a < ALPHABET) & (b < ALPHABET), F.get(model, a * ALPHABET + b)))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0)))


def random_parts(value: Column, ratios: list[float], min_ratio: float) -> Column:
    """Parts ``(from, to)`` of a string whose summed ratio reaches ``min_ratio``, each up to where its sum is highest.

    A part begins where the sum was last zero and is closed when the sum falls to zero or by ``min_ratio`` below
    its highest value.  A pair without a ratio closes it too.
    """
    def closed(acc):
        enough = (acc["top"] >= min_ratio) & (acc["end"] - acc["begin"] >= MIN_VALUE)
        return F.when(enough, F.concat(acc["out"], F.array(F.struct(acc["begin"].alias("from"), acc["end"].alias("to"))))).otherwise(acc["out"])

    def add(acc, x):
        total = acc["sum"] + F.coalesce(x, F.lit(-1e9))
        stop = (total <= 0) | (total < acc["top"] - min_ratio)
        higher = total > acc["top"]
        return F.struct(F.when(stop, 0.0).otherwise(total).alias("sum"), F.when(stop, acc["at"] + 1).otherwise(acc["begin"]).alias("begin"),
                        F.when(stop, 0.0).when(higher, total).otherwise(acc["top"]).alias("top"),
                        F.when(stop, acc["at"] + 1).when(higher, acc["at"] + 2).otherwise(acc["end"]).alias("end"),
                        (acc["at"] + 1).alias("at"), F.when(stop, closed(acc)).otherwise(acc["out"]).alias("out"))

    zero, number = F.lit(0).cast("bigint"), F.lit(0.0)
    start = F.struct(number.alias("sum"), zero.alias("begin"), number.alias("top"), zero.alias("end"), zero.alias("at"), F.array().cast(PARTS).alias("out"))
    return F.aggregate(pair_ratios(value, ratios), start, add, closed)


def _judged(value: Column, ratios: list[float], min_ratio: float) -> Column:
    """Random parts of a run; runs whose positive ratios alone don't reach the limit are done at once."""
    hole = F.regexp_replace(value, UUID, "\u00b7" * 36)
    value = F.when((F.length(value) >= 36) & value.contains("-"), hole).otherwise(value)
    most = F.aggregate(pair_ratios(value, ratios), F.lit(0.0), lambda acc, x: acc + F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    return F.when(most >= min_ratio, random_parts(value, ratios, min_ratio)).otherwise(F.array().cast(PARTS))


def scan(docs: DataFrame, ratios: list[float], min_ratio: float = 10.0) -> DataFrame:
    """``(doc_id, spans)`` per row; a span has ``start, kind, end`` in code points, end exclusive, sorted.

    ``kind`` counts through :data:`KINDS`.  Base kinds are found leftmost and non-overlapping; an assignment
    counts if its value has 8 or more characters.  Kind ``random`` reports the parts of token runs, of 8 or more
    characters, whose summed ratio reaches ``min_ratio``, so a random string behind an ordinary prefix is found and
    the prefix is not in the span.  UUIDs are left out.  It may overlap base spans, which always stay.

    A missing or empty text has no spans; every row comes back once, repeated rows too; an empty table stays
    empty; further columns are not read; a very long text is matched as a whole.  Matches are numbered and summed
    per document after one small shuffle, without the texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    found = F.concat(*[_pattern_matches(F.col("text"), kind) for kind in PATTERNS], _found(F.col("text"), RANDOM, CANDIDATE))
    items = rows.select("row", "doc_id", F.posexplode_outer(found).alias("at", "m")).select("row", "doc_id", "at", "m.*")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("from"), F.col("len").alias("to"))).cast(PARTS)
    parts = (F.when(F.col("kind") == KINDS.index(RANDOM), _judged(F.col("value"), ratios, min_ratio))
             .when(F.col("kind").isNull() | ~_valid({"kind": F.col("kind"), "value": F.col("value")}), F.array().cast(PARTS)).otherwise(whole))
    items = items.select("row", "doc_id", "at", "kind", "gap", "len", parts.alias("parts")).repartition("row")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "kind").orderBy("at"))
    items = items.withColumn("start", end - F.col("len"))
    spans = F.transform("parts", lambda p: F.struct((F.col("start") + p["from"]).alias("start"), F.col("kind").alias("kind"), (F.col("start") + p["to"]).alias("end")))
    return (items.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.when(F.size("parts") > 0, spans)).alias("spans"))
            .select("doc_id", F.sort_array(F.flatten("spans")).alias("spans")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind in PATTERNS], F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
