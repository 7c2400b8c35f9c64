"""Secret scans by regular expressions and a battery of randomness tests, with DataFrame functions only.

Known shapes (assignments, access keys, long hexadecimal runs) are found by pattern. Besides, every run of 20 or more token
characters, less what those shapes cover, is tested for randomness in the encoding it seems to have (hexadecimal, base32 or
base64). So is every part of 20 or more characters between its '/', '_' and '-', since these also join a secret to other text:

* chi-squared of its symbols against the uniform alphabet,
* a runs test of symbols in the upper against the lower half of the alphabet,
* serial correlation of neighbouring symbols.

A token can only be a secret if none of the three rejects randomness. Whether it is one is decided against ordinary text: with
the symbol frequencies q of all documents, the statistic of a text of n symbols is about non-central chi-squared with n times
(k * sum(q * q) - 1) as its non-centrality, so its lower tail is a p-value that gets sharper with length. False discoveries are
controlled by Benjamini-Hochberg steps within each encoding and length class, on counts of p-values over all documents.

Null text counts as empty: no spans. Repeated rows are scanned each. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkflow.llm.batches import stored, text_or_empty

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Most positions fail by their first three characters; classes that list their characters are looked up in one table.
ASSIGN = r"""(?=[pPsStTaA][aAeEoOpP][sScCkKiI])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = f"[{DIGIT}abcdef]{{24,}}"
SYMBOL = f"[{UPPER}{LOWER}{DIGIT}+/_-]"
#: Every match of ACCESS and HEX lies in one of these.
TOKEN = f"{SYMBOL}{{20,}}"
#: Parts of a token between the characters that may also join it to ordinary text.
PART = f"[{UPPER}{LOWER}{DIGIT}+]{{20,}}"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Symbols of each encoding in their order; the two forms of base64's last two symbols count as one.
ORDERS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
SIZES = {k: len(v) for k, v in ORDERS.items()}
#: Largest deviation, in standard deviations, at which a test does not reject randomness.
REJECT = 3.3
LENGTHS = (32, 64, 128)
SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None, group: int = 0, possible: Column | None = None) -> Column:
    """Spans of all matches, leftmost and without overlaps; ``keep`` is applied to the given group of each match.

    Texts that are not ``possible`` are known to have no match and not searched.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # What lies between the matches gives their positions.
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("found"), groups.alias("group"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["found"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        good = part["found"].isNotNull() if keep is None else part["found"].isNotNull() & (F.length(part["group"]) >= keep)
        return F.struct(
            F.coalesce(end, start).alias("at"), F.when(good, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    found = F.aggregate(parts, first, step, lambda s: s["spans"])
    matched = text.rlike(pattern) if possible is None else possible & text.rlike(pattern)
    return F.when(matched, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _free(spans: Column, base: Column) -> Column:
    """What base spans, sorted by start, leave of each span: pieces of 20 and more characters."""

    def cut(span: Column) -> Column:
        def step(state: Column, b: Column) -> Column:
            piece = F.struct(state["at"].alias("start"), F.lit(3).alias("kind"), F.least(b["start"], span["end"]).alias("end"))
            long = piece["end"] - piece["start"] >= 20
            return F.struct(
                F.greatest(state["at"], b["end"]).alias("at"), F.when(long, F.concat(state["spans"], F.array(piece))).otherwise(state["spans"]).alias("spans")
            )

        touching = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        first = F.struct(span["start"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        last = F.array(F.struct(span["end"].alias("start"), F.lit(3).alias("kind"), span["end"].alias("end")))
        return F.aggregate(F.concat(touching, last), first, step, lambda s: s["spans"])

    apart = ~F.exists(spans, lambda s: F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(apart, spans).otherwise(F.flatten(F.transform(spans, cut)))


def _tested(text: Column, spans: Column) -> Column:
    """The statistics of every candidate token.

    Step by step, since a column of a lambda is computed anew at every use: the token is cut from its text once.
    """
    kept: list[str] = []

    def step(array: Column, drop: tuple[str, ...], new: Callable[[Column], dict[str, Column]]) -> Column:
        """Every struct without some of its fields and with new ones."""
        names = [n for n in kept if n not in drop]

        def changed(s: Column) -> Column:
            fields = new(s)
            kept[:] = [*names, *fields]
            return F.struct(*[s[n].alias(n) for n in names], *[c.alias(n) for n, c in fields.items()])

        return F.transform(array, changed)

    def cut(span: Column) -> dict[str, Column]:
        return {"start": span["start"], "end": span["end"], "token": F.substring(text, span["start"] + 1, span["end"] - span["start"])}

    def encoded(t: Column) -> dict[str, Column]:
        code = F.when(t["token"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t["token"].rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
        return {"code": code, "plain": F.translate(t["token"], "-_", "+/")}

    def ordered(t: Column) -> dict[str, Column]:
        return {"order": _by_code(ORDERS, t["code"]), "plain": F.when(t["code"] == "hex", F.lower(t["plain"])).otherwise(t["plain"])}

    def counted(t: Column) -> dict[str, Column]:
        plain, order = t["plain"], t["order"]
        squares = F.aggregate(
            F.split(order, ""), F.lit(0.0), lambda s, c: s + F.pow(F.length(plain) - F.length(F.replace(plain, c, F.lit(""))), F.lit(2.0))
        )
        upper = _by_code({k: F.translate(plain, v[SIZES[k] // 2 :], "!" * (SIZES[k] // 2)) for k, v in ORDERS.items()}, t["code"])
        values = F.transform(F.split(plain, ""), lambda c: F.instr(order, c).cast("double"))
        return {"n": F.length(plain).cast("double"), "k": F.length(order).cast("double"), "squares": squares, "upper": upper, "values": values}

    def summed(t: Column) -> dict[str, Column]:
        ones = t["n"] - F.length(F.replace(t["upper"], F.lit("!"), F.lit("")))
        mean = F.aggregate(t["values"], F.lit(0.0), lambda s, v: s + v) / t["n"]
        return {"chi": t["k"] / t["n"] * t["squares"] - t["n"], "ones": ones, "runs": F.regexp_count(t["upper"], F.lit("!+|[^!]+")), "mean": mean}

    def moments(t: Column) -> dict[str, Column]:
        n, ones, mean, values = t["n"], t["ones"], t["mean"], t["values"]
        square = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: (a - mean) * (b - mean))
        return {"middle": 2 * ones * (n - ones) / n + 1, "square": square, "serial": F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)}

    def judged(t: Column) -> dict[str, Column]:
        n, k, chi, middle, square = t["n"], t["k"], t["chi"], t["middle"], t["square"]
        spread = (middle - 1) * (middle - 2) / (n - 1)
        wilson = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
        passed = (
            (wilson < REJECT)
            & F.coalesce((spread > 0) & (F.abs(t["runs"] - middle) < REJECT * F.sqrt(spread)), F.lit(False))
            & F.coalesce((square > 0) & (F.abs(t["serial"] / square + 1 / n) < REJECT / F.sqrt(n)), F.lit(False))
        )
        return {"n": n, "chi": chi, "passed": passed}

    tokens = step(spans, (), cut)
    tokens = step(tokens, ("token",), encoded)
    tokens = step(tokens, ("plain",), ordered)
    tokens = step(tokens, ("plain", "order"), counted)
    tokens = step(tokens, ("squares", "upper"), summed)
    tokens = step(tokens, ("ones", "mean", "values"), moments)
    return step(tokens, ("n", "k", "chi", "runs", "middle", "square", "serial"), judged)


def symbol_skew(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """k * sum(q * q) - 1 per encoding, from the frequencies of its symbols in all documents."""
    # Runs of symbols in pieces of three at most: a third of the rows, and no more distinct ones than three symbols can form.
    pieces = F.regexp_extract_all(text_or_empty(text), F.lit(f"{SYMBOL}{{1,3}}"), F.lit(0))
    counts = docs.select(F.explode(pieces).alias("piece")).groupBy("piece").count()
    # One row per symbol, of which there are 66 at most.
    found = counts.select(F.explode(F.split("piece", "")).alias("c"), "count").groupBy("c").agg(F.sum("count").alias("count")).collect()
    skew = {}
    for kind, order in ORDERS.items():
        counts = dict.fromkeys(order, 0)
        for r in found:
            symbol = {"-": "+", "_": "/"}.get(r["c"], r["c"])
            symbol = symbol.lower() if kind == "hex" else symbol
            if symbol in counts:
                counts[symbol] += r["count"]
        total = sum(counts.values())
        skew[kind] = SIZES[kind] * sum(n * n for n in counts.values()) / (total * total) - 1 if total else 0.0
    return skew


def _lower_tail(chi: Column, n: Column, k: Column, skew: Column) -> Column:
    """P(statistic of ordinary text <= chi): normal approximation of the non-central distribution, with an approximation of its tail that holds far out."""
    z = (chi - (k - 1 + n * skew)) / F.sqrt(2 * (k - 1) + 4 * n * skew)
    x = F.abs(z) / math.sqrt(2)
    tail = F.when(x < 1e-6, 0.5).otherwise(0.5 * (1 - F.exp(-1.98 * x)) * F.exp(-x * x) / (1.135 * math.sqrt(math.pi) * x))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _by_code(values: dict, code: Column) -> Column:
    """The value of an encoding; numbers become doubles."""
    values = {k: F.lit(float(v)) if isinstance(v, int | float) else v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return F.when(code == "hex", values["hex"]).when(code == "base32", values["base32"]).otherwise(values["base64"])


def find_secrets(docs: DataFrame, rate: float = 0.01, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row and ``spans``: an array of (start, kind, end), sorted; kind indexes KINDS.

    ``rate`` bounds the expected share of ordinary text among the added spans of each encoding and length class.
    """
    body = text_or_empty(text)
    # Columns of their own, so that none of them is computed once per use.
    scanned = docs.select(*[F.col(c) for c in carry], body.alias("__body"), body.rlike(TOKEN).alias("__long"))
    body, long = F.col("__body"), F.col("__long")
    assigned = _spans(body, ASSIGN, 0, F.lit(6), 2, F.contains(body, F.lit(":")) | F.contains(body, F.lit("=")))
    scanned = scanned.withColumn("__base", F.sort_array(F.concat(assigned, _spans(body, ACCESS, 1, possible=long), _spans(body, HEX, 2, possible=long))))
    scanned = scanned.withColumn("__token", _spans(body, TOKEN, 3, possible=long))
    scanned = scanned.withColumn("__free", _free(F.col("__token"), F.col("__base")))
    # Parts only need to be looked for in texts that have a token.
    scanned = scanned.withColumn("__part", F.when(F.size("__free") > 0, _spans(F.col("__body"), PART, 3)).otherwise(F.col("__free")))
    free = F.array_union("__free", _free(F.col("__part"), F.col("__base")))
    scanned = stored(scanned.withColumn("__tests", _tested(F.col("__body"), free)).drop("__body", "__long", "__token", "__free", "__part"), "secrets")

    skew = symbol_skew(docs, text)
    size, length = _by_code(SIZES, F.col("t.code")), F.lit(0)
    for n in LENGTHS:
        length = length + (F.col("t.n") >= n).cast("int")
    # Tokens that fail the tests count among the hypotheses, with a p-value of 1.
    p = F.when(F.col("t.passed"), _lower_tail(F.col("t.chi"), F.col("t.n"), size, _by_code(skew, F.col("t.code")))).otherwise(1.0)
    step = F.least(F.lit(3000), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300))))).cast("int")
    tests = scanned.select(F.explode("__tests").alias("t")).select(F.col("t.code").alias("code"), length.alias("length"), step.alias("step"))
    # At most 3001 steps for each of three encodings and four length classes, whatever the input.
    counts = tests.groupBy("code", "length", "step").count()
    group = Window.partitionBy("code", "length")
    ranked = counts.withColumn("below", F.sum("count").over(group.orderBy(F.desc("step")))).withColumn("all", F.sum("count").over(group))
    good = ranked.where(F.col("all") * F.pow(F.lit(10.0), -F.col("step") / 10.0) <= rate * F.col("below"))
    least = {(r["code"], r["length"]): r["least"] for r in good.groupBy("code", "length").agg(F.min("step").alias("least")).collect()}

    def chosen(t: Column) -> Column:
        length, bound = F.lit(0), F.lit(1 << 30)
        for n in LENGTHS:
            length = length + (t["n"] >= n).cast("int")
        for (code, at), value in least.items():
            bound = F.when((t["code"] == code) & (length == at), F.lit(value)).otherwise(bound)
        p = _lower_tail(t["chi"], t["n"], _by_code(SIZES, t["code"]), _by_code(skew, t["code"]))
        return t["passed"] & (F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))) >= bound)

    picked = F.filter("__tests", chosen)
    # A part of a run that is itself a secret adds nothing.
    outer = F.filter(picked, lambda t: ~F.exists(picked, lambda o: (o["start"] <= t["start"]) & (t["end"] <= o["end"]) & (o["n"] > t["n"])))
    added = F.transform(
        outer, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))
    )
    return scanned.select(*[F.col(c) for c in carry], F.sort_array(F.concat("__base", added)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""

    def step(state: Column, span: Column) -> Column:
        apart = span["start"] >= state["at"]
        piece = F.concat(F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"), F.when(apart, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out")
        )

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(spans, first, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
