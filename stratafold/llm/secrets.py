"""Secret scan: fixed patterns, and character Markov models for random strings without a pattern.

Two models give the log-likelihood of a string's character pairs: one of random strings, one of
ordinary identifiers. The best stretches of a run of token characters, found by a running sum of the
log-likelihood ratios less a drift, are spans of kind ``random`` if their mean ratio is above a
threshold; an ordinary name before or after a key does not hide it. Everything is row-wise DataFrame
expressions: no shuffle but for the counts of tokens and pairs.

Runs of less than ``SHORTEST`` characters are never called random.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.operators.lookup import quoted


def either_case(words: str) -> str:
    """A pattern's letters in either case, spelled out so that all engines agree."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# fixed values: the base patterns; equal to matching the open-ended form and dropping short matches,
# since hex and access runs are maximal
ASSIGN = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LEAST_ASSIGNED = 8
KINDS = ["assign", "access", "hex", "random"]

#: Least characters of a run that may be or hold a random string, and of the stretch that shows it. A stretch
#: that comes as near as ``EDGE`` characters to an end of its run reaches to it.
SHORTEST, STRETCH, EDGE = 16, 12, 3
#: Runs that the models judge, and shorter ones they learn from.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RANDOM_TOKEN = f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
LEARNED_TOKEN = "[A-Za-z0-9+/_=-]{8,}"
_SIZE = len(ALPHABET)
_SPAN = "array<struct<start: int, past: int, kind: int>>"
#: Neighbourhoods are counted by a hash of the words before and after, in so many classes.
_NEIGHBOURHOODS = 16


@dataclass(frozen=True)
class MarkovSettings:
    """``recurring``: least occurrences of an ordinary token; ``uniform``: share of the uniform distribution
    in the model of random strings; ``threshold``: least mean log-likelihood ratio of a pair, in nats;
    ``drop``: a stretch ends where the running sum has fallen so far below its best."""

    recurring: int = 4
    uniform: float = 0.5
    threshold: float = 0.7
    drop: float = 10.0


def _places(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, past, kind) in code points.

    The pieces between matches and the matches themselves alternate, so their lengths give the places.
    """
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    zipped = F.zip_with(
        F.slice(pieces, 1, F.size(matches)), F.arrays_zip(matches.alias("m"), values.alias("v")),
        lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match["m"]).alias("n"), F.length(match["v"]).alias("v")),
    )
    walked = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.when(
                x["v"] >= (LEAST_ASSIGNED if value_group else 0),
                F.concat(a["found"], F.array(F.struct(
                    (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("past"), F.lit(kind).alias("kind"),
                ))),
            ).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(_SPAN))


def _base(text: Column) -> Column:
    return F.concat(_places(text, ASSIGN, 0, 2), _places(text, ACCESS, 1), _places(text, HEX, 2))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _words_with_neighbours(text: Column) -> Column:
    """Words long enough to learn from, with the class of the words before and after them."""
    words = F.split(text, "\\s+")
    return F.get(F.transform(F.array(words), lambda w: F.filter(
        F.transform(w, lambda x, i: F.struct(
            x.alias("word"), F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i + 1)), F.lit(_NEIGHBOURHOODS)).alias("near")
        )),
        lambda x: F.length(x["word"]) >= 8,
    )), F.lit(0))


def ordinary_tokens(df: DataFrame, text: str = "text", settings: MarkovSettings = MarkovSettings()) -> DataFrame:
    """``token``: the recurring ordinary tokens of the whole table, patterns left out.

    A token is ordinary if it occurs often enough and no neighbourhood holds more than half of its
    occurrences. A key in copies or near copies of a text recurs as well, but nearly always between the
    same words. Tokens are counted before they are shuffled, one row per token and task.
    """
    full = F.coalesce(F.col(quoted(text)), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(full, ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = df.select(F.explode(_words_with_neighbours(rest)).alias("x")).select("x.word", "x.near")
    tokens = words.select(F.explode(F.regexp_extract_all("word", F.lit(LEARNED_TOKEN), F.lit(0))).alias("token"), "near")
    counted = tokens.groupBy("token").agg(*[F.count_if(F.col("near") == n).alias(f"n{n}") for n in range(_NEIGHBOURHOODS)])
    counts = [F.col(f"n{n}") for n in range(_NEIGHBOURHOODS)]
    total = sum(counts, F.lit(0))
    return counted.where((total >= settings.recurring) & (2 * F.greatest(*counts) <= total)).select("token")


def found_values(df: DataFrame, text: str = "text") -> DataFrame:
    """``token``: the distinct values that the base patterns find."""
    full = F.coalesce(F.col(quoted(text)), F.lit(""))
    found = F.concat(
        F.regexp_extract_all(full, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(full, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(full, F.lit(HEX), F.lit(0)),
    )
    return df.select(F.explode(F.filter(found, lambda v: F.length(v) >= LEAST_ASSIGNED)).alias("token")).distinct()


def train(df: DataFrame, text: str = "text", settings: MarkovSettings = MarkovSettings()) -> list[float]:
    """Log-likelihood ratios of all character pairs, row by row of the first character.

    Labelled samples come from the whole table: values found by the base patterns are random strings,
    ``ordinary_tokens`` are the others; every distinct token counts once. Counts are at most
    ``2 * len(ALPHABET) ** 2`` rows. Without any sample the ratio compares the uniform distribution with
    itself and finds nothing.
    """
    labelled = found_values(df, text).select(F.lit(1).alias("label"), "token").unionByName(
        ordinary_tokens(df, text, settings).select(F.lit(0).alias("label"), "token")
    )
    coded = labelled.select("label", _codes(F.col("token")).alias("c"))
    pairs = coded.select("label", F.explode(F.arrays_zip(
        F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b")
    )).alias("p")).select("label", "p.a", "p.b").where("a >= 0 AND b >= 0")
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _ratios(counts, settings.uniform)


def _ratios(counts: dict[tuple[int, int, int], int], uniform: float, prior: float = 4.0) -> list[float]:
    """Pairs are smoothed by ``prior`` characters of the model's own frequencies, these by one of the
    uniform distribution; the model of random strings is mixed with the uniform distribution."""
    even = 1.0 / _SIZE
    follow, sums, totals = {}, {}, [0, 0]
    for (label, a, b), n in counts.items():
        follow[label, b] = follow.get((label, b), 0) + n
        sums[label, a] = sums.get((label, a), 0) + n
        totals[label] += n

    def likely(label: int, a: int, b: int) -> float:
        single = (follow.get((label, b), 0) + even) / (totals[label] + 1)
        return (counts.get((label, a, b), 0) + prior * single) / (sums.get((label, a), 0) + prior)

    return [
        math.log((uniform * even + (1 - uniform) * likely(1, a, b)) / likely(0, a, b))
        for a in range(_SIZE) for b in range(_SIZE)
    ]


def _stretches(token: Column, table: list[float], settings: MarkovSettings) -> Column:
    """The random stretches of a run of token characters as (start, past) within it.

    A running sum of the pairs' ratios less half the threshold begins anew where it has fallen to zero,
    or by ``drop`` below its best; a stretch reaches up to the best. It counts if it is long enough and its
    mean ratio reaches the threshold. A run in capitals alone is judged as if in small letters: shouting is
    not random.
    """
    said = F.when(token.rlike("[a-z0-9]"), token).otherwise(F.lower(token))
    ratios = F.expr("CAST(split('" + ",".join(f"{x:.6g}" for x in table) + "', ',') AS array<double>)")
    drift = settings.threshold / 2
    steps = F.get(F.transform(F.array(_codes(said)), lambda c: F.zip_with(
        F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1),
        lambda a, b: F.coalesce(F.get(ratios, a * _SIZE + b), F.lit(0.0)) - drift,
    )), F.lit(0))
    empty = F.array().cast("array<struct<start: int, past: int>>")

    def ended(s: Column) -> Column:
        return (s["sum"] <= 0) | (s["best"] - s["sum"] > settings.drop)

    def counted(s: Column) -> Column:
        pairs = s["end"] - s["start"]
        good = (pairs + 1 >= STRETCH) & (s["best"] + drift * pairs >= settings.threshold * pairs)
        return F.when(good, F.concat(s["found"], F.array(F.struct(s["start"].alias("start"), (s["end"] + 1).alias("past"))))).otherwise(s["found"])

    def step(s: Column, x: Column) -> Column:
        over = ended(s)
        best, total = F.when(over, 0.0).otherwise(s["best"]), F.when(over, 0.0).otherwise(s["sum"]) + x
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(over, s["at"]).otherwise(s["start"]).alias("start"), total.alias("sum"),
            F.greatest(best, total).alias("best"),
            F.when(total > best, s["at"] + 1).when(over, s["at"]).otherwise(s["end"]).alias("end"),
            F.when(over, counted(s)).otherwise(s["found"]).alias("found"),
        )

    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), empty.alias("found")
    )
    return F.aggregate(steps, start, step, counted)


def _random(text: Column, table: list[float], settings: MarkovSettings) -> Column:
    """Spans of the stretches that the models take for random strings."""
    pieces = F.split(text, RANDOM_TOKEN, -1)
    tokens = F.regexp_extract_all(text, F.lit(RANDOM_TOKEN), F.lit(0))
    zipped = F.zip_with(
        F.slice(pieces, 1, F.size(tokens)), tokens,
        lambda piece, token: F.struct(
            F.length(piece).alias("gap"), F.length(token).alias("n"), _stretches(token, table, settings).alias("random")
        ),
    )
    walked = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(a["found"], F.transform(x["random"], lambda r: F.struct(
                (a["at"] + x["gap"] + F.when(r["start"] > EDGE, r["start"]).otherwise(0)).alias("start"),
                (a["at"] + x["gap"] + F.when(r["past"] < x["n"] - EDGE, r["past"]).otherwise(x["n"])).alias("past"),
                F.lit(3).alias("kind"),
            ))).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.when(text.rlike(RANDOM_TOKEN), walked).otherwise(F.array().cast(_SPAN))


def _outside(more: Column, base: Column) -> Column:
    """The parts of spans that lie outside of all base spans (sorted by their start)."""

    def parts(span: Column) -> Column:
        met = F.filter(base, lambda b: (b["start"] < span["past"]) & (span["start"] < b["past"]))
        part = lambda a, z: F.array(F.struct(a.alias("start"), z.alias("past"), F.lit(3).alias("kind")))
        return F.aggregate(
            met,
            F.struct(span["start"].alias("at"), F.array().cast(_SPAN).alias("found")),
            lambda s, b: F.struct(
                F.greatest(s["at"], b["past"]).alias("at"),
                F.when(b["start"] > s["at"], F.concat(s["found"], part(s["at"], b["start"]))).otherwise(s["found"]).alias("found"),
            ),
            lambda s: F.when(s["at"] < span["past"], F.concat(s["found"], part(s["at"], span["past"]))).otherwise(s["found"]),
        )

    return F.flatten(F.transform(more, parts))


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def with_spans(
    df: DataFrame, table: list[float], text: str, base: str, spans: str, settings: MarkovSettings = MarkovSettings()
) -> DataFrame:
    """Add the columns ``base`` and ``spans``, sorted arrays of (start, kind, past); the latter also has the
    random stretches, without the parts that base spans cover. The names must be unused."""
    ordered = lambda found: F.sort_array(F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["past"].alias("past"))))
    full = F.coalesce(F.col(quoted(text)), F.lit(""))
    (more,) = unused(df, "_more")
    based = df.withColumn(base, ordered(_base(full))).withColumn(more, _random(full, table, settings))
    same = F.transform(F.col(base), lambda s: F.struct(s["start"].alias("start"), s["past"].alias("past"), s["kind"].alias("kind")))
    return based.withColumn(spans, ordered(F.concat(same, _outside(F.col(more), F.col(base))))).drop(more)


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.lit(KINDS)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["past"].cast("string"))), ",")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", settings: MarkovSettings = MarkovSettings()) -> DataFrame:
    """One row per row of ``df``: its key, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``,
    ``spans`` and ``n_random``.

    A missing text counts as empty and has no spans; missing and repeated keys stay row by row; other
    columns are not read; an empty table gives none.
    """
    rows = df.select(F.col(key), F.col(text).alias("_text"))
    found = with_spans(rows, train(rows, "_text", settings), "_text", "_base", "_spans", settings)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("_base").cast("binary"), 256).alias("base_sha256"), listed("_spans").alias("spans"),
        count(3).alias("n_random"),
    )


def redact(
    df: DataFrame, text: str = "text", mark: str = "[SECRET]", settings: MarkovSettings = MarkovSettings()
) -> DataFrame:
    """All rows and columns of ``df``; every span of the text is replaced by ``mark``, overlapping and adjacent
    spans by one mark.

    A missing text stays missing, an empty one empty; repeated rows are redacted alike and all stay; an
    empty table gives none. Columns may have any names.
    """
    full, base, spans = unused(df, "_full", "_base", "_spans")
    rows = df.withColumn(full, F.col(quoted(text)))
    found = with_spans(rows, train(df, text, settings), full, base, spans, settings)
    merged = F.expr(f"""
    aggregate({spans}, CAST(array() AS array<struct<start: int, past: int>>), (a, s) ->
      IF(size(a) > 0 AND get(a, size(a) - 1).past >= s.start,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', get(a, size(a) - 1).start,
          'past', greatest(get(a, size(a) - 1).past, s.past)))),
        concat(a, array(named_struct('start', s.start, 'past', s.past)))))""")
    joined = found.withColumn(base, merged)
    kept = F.expr(f"""concat(
      array(substring({full}, 1, get({base}, 0).start)),
      transform(sequence(0, size({base}) - 1), i -> substring({full}, get({base}, i).past + 1,
        coalesce(get({base}, i + 1).start, length({full})) - get({base}, i).past)))""")
    cleaned = F.when(F.size(spans) == 0, F.col(quoted(text))).otherwise(F.array_join(kept, mark))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(quoted(c)) for c in df.columns])
