"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Only DataFrame functions. Patterns find the credentials that are named or have a known form. Of all other
long tokens the battery asks three questions, each against what readable or counted strings look like:

* are the symbols of its encoding more evenly used than in text (chi-squared),
* do character classes change more often (runs),
* do neighbours depend less on each other than in sequences (lag-one serial correlation)?

The three scores are added, so that each makes the others' evidence stronger, and the sum is compared with its centre
and spread among readable tokens of the encoding, which hold the correlation between the tests. Short tokens
give weak evidence, and there are many of them, so false discoveries are controlled among tokens of the
same encoding and like length.

The forecasting project has no texts, so the operator is general.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import free_names

# The patterns of named and well-formed secrets.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Encodings, tried in this order: name, pattern, alphabet, how often two symbols of readable strings agree.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS, 0.2),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef", 0.15),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.15),
    ("lower", r"^[a-z]+$", LOWER, 0.065),
    ("upper", r"^[A-Z]+$", UPPER, 0.065),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567", 0.065),
    ("lower36", r"^[a-z0-9]+$", LOWER + DIGITS, 0.065),
    ("upper36", r"^[A-Z0-9]+$", UPPER + DIGITS, 0.065),
    ("letters", r"^[A-Za-z]+$", LOWER + UPPER, 0.05),
    ("base62", r"^[A-Za-z0-9]+$", LOWER + UPPER + DIGITS, 0.05),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.05),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.05),
    ("mixed", r"", UPPER + LOWER + DIGITS + "+/-_", 0.05),
)
ONE_CLASS = ("decimal", "lower", "upper")
CLASS_CHANGES = 0.4
SEQUENCE_CORRELATION = 0.25
SERIAL_WEIGHT = 0.5
# Centre and spread of the sum of scores, measured on 37,000 identifiers of common English words (snake, kebab, camel and
# title case, paths, with and without numbers). The spread is that of the upper tail, from the median to the 99.9 % quantile.
READABLE = {"letters": (0.35, 1.15), "lower": (0.5, 0.7), "upper": (0.5, 0.7)}
READABLE |= dict.fromkeys(("decimal", "hex", "HEX", "base32", "lower36", "upper36"), (0.5, 1.0))
READABLE |= dict.fromkeys(("base62", "base64", "base64url", "mixed"), (1.8, 1.1))
LENGTHS = (24, 32, 48, 64)
BIN = 0.05
BINS = 2000

SPANS = "array<struct<start:int,order:int,stop:int,kind:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(text: Column, pattern: str, kind: str, passes=None) -> Column:
    """Spans of the leftmost matches, those that pass only.

    Pieces and matches alternate, so their lengths in code points add up to places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    order, none = KINDS.index(kind), F.array().cast(SPANS)

    def step(state, pair):
        start = state["at"] + F.char_length(pair["piece"])
        stop = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), stop.alias("stop"), F.lit(kind).alias("kind"))
        found = F.array_append(state["found"], span)
        if passes:
            found = F.when(passes(pair["match"]), found).otherwise(state["found"])
        return F.struct(found.alias("found"), stop.alias("at"))

    def walk(found: Column) -> Column:
        pairs = F.zip_with(
            F.split(text, pattern, -1), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))
        )
        begin = F.struct(none.alias("found"), F.lit(0).alias("at"))
        return F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), begin, step, lambda s: s["found"])

    return _let(matches, lambda found: F.when(F.size(found) > 0, walk(found)).otherwise(none))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution by the usual five-term polynomial."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _facts(token: Column) -> Column:
    """The token without padding, with the narrowest encoding that holds it."""
    core = F.rtrim(token, F.lit("="))

    def known(name, alphabet, agree):
        return F.struct(
            F.lit(name).alias("encoding"), F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("size"),
            F.lit(agree).alias("agree"),
        )

    def named(text):
        name, _, alphabet, agree = ENCODINGS[-1]
        found = known(name, alphabet, agree)
        for name, pattern, alphabet, agree in reversed(ENCODINGS[:-1]):
            found = F.when(text.rlike(pattern), known(name, alphabet, agree)).otherwise(found)
        return F.struct(text.alias("text"), F.char_length(text).cast("double").alias("n"), found.alias("of"))

    return _let(core, named)


def _evenness(facts: Column) -> Column:
    """How many standard deviations chi-squared lies below what text of this length would give."""
    n, size, agree, text = facts["n"], facts["of"]["size"], facts["of"]["agree"], facts["text"]
    squares = _total(F.transform(
        F.split(facts["of"]["alphabet"], ""),
        lambda a: F.pow(n - F.char_length(F.replace(text, a, F.lit(""))), F.lit(2.0)),
    ))
    chi = size / n * squares - n
    expected = size * (1 + (n - 1) * agree) - n
    away = F.greatest(n * (size * agree - 1), F.lit(0.0))
    return (expected - chi) / F.sqrt(2 * (size - 1 + 2 * away))


def _class_runs(facts: Column) -> Column:
    """How many standard deviations the class changes lie above those of readable tokens; null if the
    encoding has one class."""
    n = facts["n"]
    classes = F.translate(facts["text"], LOWER + UPPER + DIGITS + "+/-_", "a" * 26 + "A" * 26 + "0" * 10 + "+" * 4)
    changes = F.char_length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1
    z = (changes - (n - 1) * CLASS_CHANGES) / F.sqrt((n - 1) * CLASS_CHANGES * (1 - CLASS_CHANGES))
    return F.when(~facts["of"]["encoding"].isin(*ONE_CLASS), z)


def _independence(facts: Column) -> Column:
    """How many standard deviations the correlation of neighbours lies below that of sequences.

    Readable tokens and random ones score alike here; counted and stepped ones score far below."""
    codes = F.transform(F.split(facts["text"], ""), lambda c: F.instr(facts["of"]["alphabet"], c).cast("double"))

    def correlation(centred):
        size = F.size(centred)
        lagged = F.zip_with(F.slice(centred, 1, size - 1), F.slice(centred, 2, size - 1), lambda a, b: a * b)
        spread = _total(F.transform(centred, lambda c: c * c))
        return F.when(spread > 0, _total(lagged) / spread).otherwise(F.lit(1.0))

    centred = _let(codes, lambda own: _let(_total(own) / facts["n"], lambda mean: F.transform(own, lambda c: c - mean)))
    serial = _let(centred, correlation)
    return (F.atanh(F.lit(SEQUENCE_CORRELATION)) - F.atanh(F.least(F.abs(serial), F.lit(0.999999)))) * F.sqrt(facts["n"] - 3)


def randomness(token: Column) -> Column:
    """(``stratum``: encoding and length class, ``p_value`` of the summed scores among readable tokens)."""

    def judged(facts):
        length = F.lit("0")
        for i, least in enumerate(LENGTHS, 1):
            length = F.when(facts["n"] >= least, F.lit(str(i))).otherwise(length)
        score = _evenness(facts) + SERIAL_WEIGHT * _independence(facts) + F.coalesce(_class_runs(facts), F.lit(0.0))
        of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in READABLE.items() for x in (k, v[i])]), facts["of"]["encoding"])
        return F.struct(
            F.concat_ws("/", facts["of"]["encoding"], length).alias("stratum"), _let((score - of(0)) / of(1), _tail).alias("p_value")
        )

    return _let(_facts(token), judged)


def discovery_limits(tested: DataFrame, rate: float) -> DataFrame:
    """(stratum, limit): tokens with p at or below the limit keep the share of false discoveries at ``rate``.

    The step-up rule on p-values in bins of their logarithm, each bin standing for its largest p: the
    histogram of a stratum has a fixed number of rows, however many tokens there are. A stratum without
    discoveries has no row.
    """
    place = F.floor(-F.log10(F.greatest("p_value", F.lit(1e-300))) / BIN)
    binned = tested.select("stratum", F.least(place, F.lit(BINS)).cast("int").alias("bin")).groupBy("stratum", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    ranked = binned.select(
        "stratum", "bin", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("stratum")).alias("tests")
    )
    edge = F.pow(F.lit(10.0), -F.col("bin") * BIN)
    return ranked.where(edge <= F.lit(rate) * F.col("rank") / F.col("tests")).groupBy("stratum").agg(
        F.pow(F.lit(10.0), -F.min("bin") * BIN).alias("limit")
    )


def find_secrets(df: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """Add ``base_spans`` and ``spans`` to every row: arrays of (start, order, stop, kind) in code points,
    ordered by start, then kind.

    General: the forecasting project has no texts. Base spans are the fixed patterns, leftmost and without overlap within a kind. ``spans`` adds the
    tokens of at least 20 symbols that the battery finds random at false-discovery ``rate`` over the
    distinct tokens of all rows, unless they touch a base span. Null and empty texts have no spans;
    repeated rows get the same; columns named like the new ones are replaced; an empty table stays empty.
    Rows are not shuffled: only distinct tokens are counted, and one limit per encoding and length
    class (at most 65) comes back to the driver.
    """
    kept = free_names(df, ["base_spans", "spans"], [text])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    tokens = df.select(F.explode(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))).alias("token")).distinct()
    limits = discovery_limits(tokens.select(randomness(F.col("token")).alias("r")).select("r.*"), rate).collect()
    base = F.array_sort(F.concat(
        _placed(body, ASSIGN, "assign", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS),
        _placed(body, ACCESS, "access"),
        _placed(body, HEX, "hex"),
    ))
    scanned = kept.withColumn("base_spans", base)
    if not limits:
        return scanned.withColumn("spans", F.col("base_spans"))

    def random(token):
        found = randomness(token)

        def below(r):
            within = F.lit(False)
            for row in limits:
                within = F.when(r["stratum"] == row["stratum"], r["p_value"] <= row["limit"]).otherwise(within)
            return within

        return _let(found, below)

    free = F.filter(
        _placed(body, TOKEN, "random", random),
        lambda t: ~F.exists("base_spans", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
    )
    return scanned.withColumn("spans", F.array_sort(F.concat("base_spans", free)))


def span_text(spans: str | Column) -> Column:
    """kind:start:stop of every span, joined by commas."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
