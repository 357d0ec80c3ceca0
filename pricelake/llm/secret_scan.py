"""Secret scans: fixed patterns, and a randomness test battery for tokens that no pattern knows.

All of it is Spark SQL functions. Where a pattern matches is found by splitting the text at it: the gaps and the
matches, put back together, give every position.

A token of at least MIN_TOKEN characters of an encoding's alphabet, with letters and digits, is tested twice.

The battery asks if its characters are drawn uniformly from the alphabet of the encoding that it seems to have:
chi-squared uniformity, a runs test of the lower and upper half of the alphabet, and serial correlation at lag one,
combined by Fisher's method. What fails it (a p-value under LEAST_P) is no secret.

The other test asks if it is an ordinary word or identifier: its letters repeat as letters of the corpus's own texts do,
and it steps between letters and digits as seldom as these, or as identifiers (LEAST_CHANGE). Fewer repeats and more steps
speak against that. Since short tokens can tell less, tokens are judged within classes of length: over all tokens
of the corpus in a class, the Benjamini-Hochberg procedure says which are not ordinary, so that of the secrets reported
a share of FDR at most is expected to be false. Those that pass the battery too are spans of kind random. Tokens under
MIN_TOKEN characters are never tested; a base32 key of 20 characters is too short to be told from an identifier.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: the kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
FDR, LEAST_P = 0.05, 0.01
#: Identifiers step between letters and digits at so many of their places, in the corpus's prose it is less.
LEAST_CHANGE = 0.08
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_STEP, _PAIR = "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", "[A-Za-z0-9](?=[A-Za-z0-9])"
#: Matches whose places are added up together; a text with many matches costs in proportion to their number.
_TOGETHER = 256
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-",
}

_SPAN = "array<struct<start:int,end:int,kind:int,found:string,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, kind: int, value_group: int | None, possible: Column) -> Column:
    """Spans of the leftmost non-overlapping matches: start, end, kind, the match and a group of it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), values.alias("value"))
    parts = F.filter(parts, lambda p: p["found"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.length(part["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), part["found"].alias("found"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def stretches(parts: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(parts), F.lit(_TOGETHER)), lambda i: i < F.size(parts))
        return F.transform(firsts, lambda i: F.aggregate(F.slice(parts, i + 1, F.lit(_TOGETHER)), start, add))

    def add_stretch(state: Column, stretch: Column) -> Column:
        moved = F.transform(
            stretch["spans"],
            lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["kind"].alias("kind"), s["found"].alias("found"), s["value"].alias("value")),
        )
        return F.struct((state["at"] + stretch["at"]).alias("at"), F.concat(state["spans"], moved).alias("spans"))

    spans = let(parts, lambda p: F.aggregate(stretches(p), start, add_stretch, lambda s: s["spans"]))
    return F.when(possible, spans).otherwise(F.array().cast(_SPAN))


def pattern_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start, then kind."""
    lower = F.lower(text)
    possible = F.contains(lower, F.lit(KEYWORDS[0]))
    for word in KEYWORDS[1:]:
        possible = possible | F.contains(lower, F.lit(word))
    assign = F.filter(_matches(text, ASSIGN, 0, 2, possible), lambda s: F.length(s["value"]) >= 8)
    access = _matches(text, ACCESS, 1, None, F.contains(text, F.lit("AKIA")))
    hexes = _matches(text, HEX, 2, None, text.rlike(HEX))
    return F.array_sort(F.concat(assign, access, hexes))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to about 1e-7 (a rational approximation that is in public use)."""

    def tail(z: Column) -> Column:
        # The coefficients of formula 26.2.17 in Abramowitz and Stegun's handbook.
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * let(1 / (1 + 0.2316419 * F.abs(z)), poly)

    return let(z, lambda z: F.when(z >= 0, tail(z)).otherwise(1 - tail(z)))


def alphabet_of(token: Column) -> Column:
    """The alphabet of the encoding that a token seems to have; null if it lacks letters or digits."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    pick = (
        F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), _ALPHABETS["hex"])
        .when(token.rlike("^[A-Z2-7]+$"), _ALPHABETS["base32"])
        .when(token.rlike("^[0-9a-z]+$"), _ALPHABETS["lower"])
        .when(token.rlike("^[0-9A-Za-z]+$"), _ALPHABETS["base62"])
        .otherwise(_ALPHABETS["base64"])
    )
    return F.when(mixed, pick)


def _total(xs: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + term(x))


def _uniformity(m: Column) -> Column:
    """p-value of the chi-squared statistic, by its exact mean and variance over equally likely texts."""
    square = lambda v: F.pow(F.size(F.filter(m["xs"], lambda x: x == v)).cast("double"), F.lit(2.0))
    statistic = m["k"] / m["n"] * _total(F.array_distinct(m["xs"]), square) - m["n"]
    return upper_tail((statistic - (m["k"] - 1)) / F.sqrt(2 * (m["k"] - 1) * (m["n"] - 1) / m["n"]))


def _runs(m: Column) -> Column:
    """p-value of the number of runs of the alphabet's lower and upper half."""
    upper = lambda x: x * 2 >= m["k"]
    count = 1 + _total(m["pairs"], lambda p: F.when(upper(p["x"]) != upper(p["y"]), 1.0).otherwise(0.0))
    high = _total(m["xs"], lambda x: F.when(upper(x), 1.0).otherwise(0.0))

    def tail(r: Column) -> Column:
        spread = F.sqrt(F.greatest((r["mean"] - 1) * (r["mean"] - 2) / (m["n"] - 1), F.lit(1e-9)))
        return F.least(F.lit(1.0), 2 * upper_tail(F.abs(r["count"] - r["mean"]) / spread))

    mean = let(high, lambda h: 2 * h * (m["n"] - h) / m["n"] + 1)
    return let(F.struct(count.alias("count"), mean.alias("mean")), tail)


def _serial(m: Column) -> Column:
    """p-value of the correlation of neighbouring characters' places in the alphabet."""

    def tail(mean: Column) -> Column:
        power = _total(m["xs"], lambda x: (x - mean) * (x - mean))
        lag = _total(m["pairs"], lambda p: (p["x"] - mean) * (p["y"] - mean)) / F.greatest(power, F.lit(1e-9))
        return F.least(F.lit(1.0), 2 * upper_tail(F.abs(lag + 1 / m["n"]) * F.sqrt(m["n"])))

    return let(_total(m["xs"], lambda x: x) / m["n"], tail)


def randomness(token: Column) -> Column:
    """Fisher's combined p-value of the battery; null for tokens without letters or digits, which aren't tested."""

    def marks(t: Column) -> Column:
        folded = F.when(F.length(t["alphabet"]) == 16, F.lower(t["token"])).otherwise(t["token"])
        xs = F.transform(F.split(folded, ""), lambda c: (F.instr(t["alphabet"], c) - 1).cast("double"))
        return let(
            xs,
            lambda xs: F.struct(
                xs.alias("xs"),
                F.arrays_zip(F.slice(xs, F.lit(1), F.size(xs) - 1).alias("x"), F.slice(xs, F.lit(2), F.size(xs) - 1).alias("y")).alias("pairs"),
                F.size(xs).cast("double").alias("n"),
                F.length(t["alphabet"]).cast("double").alias("k"),
            ),
        )

    def combined(m: Column) -> Column:
        half = -sum((F.log(F.greatest(test(m), F.lit(1e-12))) for test in (_uniformity, _runs, _serial)), F.lit(0.0))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    known = F.struct(token.alias("token"), alphabet_of(token).alias("alphabet"))
    return let(known, lambda t: F.when(t["alphabet"].isNotNull(), let(marks(t), combined)))


def length_class(token: Column) -> Column:
    """Classes of length, each half as wide again as the one before; all of 20 * 1.5^12 = 2595 and over are one."""
    return F.least(F.floor(F.log(F.length(token) / F.lit(float(MIN_TOKEN))) / math.log(1.5)), F.lit(12)).cast("int")


def ordinary(docs: DataFrame) -> tuple[float, float, float]:
    """Of all texts: how often two letters are the same, how often three are, and how often letters and digits meet."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(text.alias("text"), F.lower(text).alias("low"))
    counts = [F.sum((F.octet_length("low") - F.octet_length(F.replace("low", F.lit(c)))).cast("double")) for c in _LETTERS]
    met = [F.sum(F.regexp_count("text", F.lit(p)).cast("double")) for p in (_STEP, _PAIR)]
    found = [x or 0.0 for x in each.agg(*(c.alias(f"c{i}") for i, c in enumerate([*counts, *met]))).first()]
    letters, (steps, pairs) = found[:26], found[26:]
    share = [(n + 1) / (sum(letters) + 26) for n in letters]
    return sum(q * q for q in share), sum(q**3 for q in share), min(0.5, max(LEAST_CHANGE, steps / max(1.0, pairs)))


def ordinariness(token: Column, prose: tuple[float, float, float]) -> Column:
    """p-value of the hypothesis that a token is an ordinary word or identifier; ``prose`` is what ``ordinary`` found."""
    two, three, change = prose

    def repeats(letters: Column) -> Column:
        """Few equal pairs of letters, by the mean and variance of their number in ordinary text."""
        m = F.length(letters).cast("double")
        own = F.split(letters, "")
        equal = let(own, lambda xs: _total(F.array_distinct(xs), lambda v: let(F.size(F.filter(xs, lambda x: x == v)).cast("double"), lambda n: n * (n - 1) / 2)))
        pairs = m * (m - 1) / 2
        spread = F.sqrt(F.greatest(pairs * two * (1 - two) + m * (m - 1) * (m - 2) * (three - two * two), F.lit(1e-9)))
        return F.when(m >= 2, upper_tail((pairs * two - equal - 0.5) / spread)).otherwise(1.0)

    def steps(token: Column) -> Column:
        """Many steps between letters and digits, by Zubkov and Serov's bound on a binomial tail."""

        def bound(s: Column) -> Column:
            share = F.least((s["k"] - 1) / s["n"], F.lit(1 - 1e-9))
            divergence = share * F.log(F.greatest(share, F.lit(1e-9)) / change) + (1 - share) * F.log((1 - share) / (1 - change))
            return F.when(share > change, upper_tail(F.sqrt(2 * s["n"] * F.greatest(divergence, F.lit(0.0))))).otherwise(1.0)

        return let(F.struct(F.regexp_count(token, F.lit(_STEP)).cast("double").alias("k"), (F.length(token) - 1).cast("double").alias("n")), bound)

    letters = F.regexp_replace(F.lower(token), "[^a-z]", "")
    half = -F.log(F.greatest(let(letters, repeats), F.lit(1e-300))) - F.log(F.greatest(steps(token), F.lit(1e-300)))
    return let(half, lambda h: F.exp(-h) * (1 + h))


def _tokens(text: Column, prose: tuple[float, float, float]) -> Column:
    """(start, end, kind, class, p, q) of each token that is tested: p of the battery, q of the test of ordinary tokens."""
    spans = _matches(text, TOKEN, 3, None, text.rlike(TOKEN))
    spans = F.transform(
        spans,
        lambda s: F.struct(s["start"], s["end"], s["kind"], length_class(s["found"]).alias("class"), randomness(s["found"]).alias("p"), ordinariness(s["found"], prose).alias("q")),
    )
    return F.filter(spans, lambda s: s["p"].isNotNull())


def _step(q: Column) -> Column:
    return F.least(F.floor(-20 * F.log10(F.greatest(q, F.lit(1e-12)))), F.lit(240)).cast("int")


def cutoffs(docs: DataFrame, prose: tuple[float, float, float], fdr: float = FDR) -> dict[int, int]:
    """By class of length: tokens whose p-value is in this step or a smaller one are not ordinary. From all tokens of all texts.

    p-values are counted in steps of a 20th of a power of ten, so at most 13 classes of 241 rows reach the driver. A
    class in which none is surely not ordinary isn't in it.
    """
    tokens = docs.select(F.explode(_tokens(F.coalesce("text", F.lit("")), prose)).alias("t"))
    counts: dict[int, dict[int, int]] = {}
    for row in tokens.groupBy(F.col("t.class").alias("class"), _step(F.col("t.q")).alias("step")).count().collect():
        counts.setdefault(row["class"], {})[row["step"]] = row["count"]
    out = {}
    for kind, steps in counts.items():
        total, seen = sum(steps.values()), 0
        for step, n in sorted(steps.items(), reverse=True):
            seen += n
            if 10 ** (-step / 20) <= fdr * seen / total:  # the greatest p-value of the step
                out[kind] = step
    return out


def all_spans(text: Column, limits: dict[int, int], prose: tuple[float, float, float]) -> Column:
    """Pattern spans and random tokens that overlap none of them, by start, then kind."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map(F.lit(-1), F.lit(0))
    far = lambda t: F.coalesce(_step(t["q"]) >= F.try_element_at(table, t["class"]), F.lit(False))
    random = F.filter(_tokens(text, prose), lambda t: far(t) & (t["p"] >= LEAST_P))

    def joined(base: Column) -> Column:
        free = F.filter(random, lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
        return F.array_sort(F.concat(base, F.transform(free, lambda t: F.struct(t["start"], t["end"], t["kind"]))))

    return let(F.transform(pattern_spans(text), lambda s: F.struct(s["start"], s["end"], s["kind"])), joined)


def _written_out(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def spans_of(docs: DataFrame, fdr: float = FDR) -> Column:
    """The secrets in the text column of ``docs``, an array of (start, end, kind); learnt from all its texts."""
    prose = ordinary(docs)
    return all_spans(F.coalesce(docs["text"], F.lit("")), cutoffs(docs, prose, fdr), prose)


def scan(docs: DataFrame, fdr: float = FDR, name: str = "_secrets") -> DataFrame:
    """Secrets in every whole text: the input's columns and ``name``, an array of (start, end, kind), which replaces one of that name.

    Positions are in code points, end exclusive; kind 0 to 2 is one of KINDS, 3 a random token. Null and empty texts have
    none. Spans of different patterns may overlap. Repeated rows are scanned each. An empty table gives an empty result.
    """
    return docs.withColumn(name, spans_of(docs, fdr))


def summary(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document."""
    rows = docs.select("doc_id", spans_of(docs, fdr).alias("found"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counted = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counted, F.sha2(_written_out(base), 256).alias("base_sha256"), _written_out(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """The documents with each secret replaced by ``mark``; overlapping spans count as one. n_chars follows the text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, span: Column) -> Column:
        between = F.substring(F.col("doc.text"), state["at"] + 1, span["start"] - state["at"])
        parts = F.concat(state["parts"], F.array(between, F.lit(mark)))
        inside = F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["parts"].alias("parts"))
        return F.when(span["start"] < state["at"], inside).otherwise(F.struct(span["end"].alias("at"), parts.alias("parts")))

    def end(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(F.col("doc.text"), state["at"] + 1, F.length("doc.text")))

    rows = docs.select(F.struct(*docs.columns).alias("doc"), spans_of(docs, fdr).alias("found"))
    rows = rows.withColumn("made", F.when(F.size("found") > 0, F.aggregate("found", start, add, end)))
    out = []
    for field in docs.schema.fields:
        own = F.col("doc").getField(field.name)
        if field.name == "text":
            own = F.coalesce("made", own)
        elif field.name == "n_chars":
            own = F.coalesce(F.length("made").cast(field.dataType), own)
        out.append(own.alias(field.name))
    return rows.select(*out)
