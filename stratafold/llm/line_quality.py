"""Quality rules with the frequency of lines across documents.

Only DataFrame expressions. The texts are read once: a scan makes, per row, the counts of the fixed
rules and a short array of (hash, words) of its normalised lines. All that is shuffled later are
those hashes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.operators.lookup import lookup_join, quoted
from stratafold.session import stage

# fixed values: words of these rules are separated by ASCII white space
SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class LineLimits:
    """A line is template text of its host if it stands in at least ``documents`` documents and in
    at least ``share`` of the host's documents or ``enough`` of them, whichever is less. Documents with
    the same set of lines count as one, and those of which more than ``copied`` of the lines and of the
    words reach these limits do not count: they are copies or near copies of each other, which are left
    to the duplicate removal. A document is depleted if less than ``left`` of its words remain."""

    documents: int = 10
    share: float = 0.02
    enough: int = 500
    copied: float = 0.5
    left: float = 0.3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _repeat_words(windows: str, width: int) -> str:
    """Positions covered by windows whose hash occurs twice or more; linear but for one sort."""
    return f"""
    aggregate(
      transform(array(sort_array(transform({windows}, (x, i) -> named_struct('h', x, 'i', i)))), s ->
        sort_array(transform(
          filter(sequence(0, size(s) - 1), i ->
            coalesce(get(s, i).h = get(s, i - 1).h, false) or coalesce(get(s, i).h = get(s, i + 1).h, false)),
          i -> get(s, i).i)))[0],
      named_struct('n', 0, 'past', 0),
      (a, p) -> named_struct('n', a.n + {width} - greatest(a.past - p, 0), 'past', p + {width}),
      a -> a.n)"""


def base_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and
    ``base_failed`` to ``df``; none of these names may be among its columns. A missing text counts
    as empty. Windows are compared by 64-bit hash within one text."""
    full = F.coalesce(F.col(text), F.lit(""))
    split = df.withColumn("_words", words_of(full)).withColumn(
        "_lines", F.filter(F.split(full, "\n"), lambda line: line.rlike(NO_SPACE))
    )
    hashed = split.withColumn("n_words", F.size("_words").cast("bigint")).withColumn(
        "_windows",
        F.expr("IF(n_words >= 9, transform(sequence(1, size(_words) - 7), i -> xxhash64(slice(_words, i, 8))), array())"),
    )
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    counted = hashed.select(
        *df.columns, "n_words",
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(full, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(repeats, F.expr(_repeat_words("_windows", 8))).otherwise(0).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def normalised(text: Column) -> Column:
    """Lower case, digits as 0, other white space than line ends as single spaces."""
    small = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    return F.regexp_replace(small, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")


def _line_array(text: Column) -> Column:
    """(hash, words) of each line with a word, trimmed and normalised, in order."""
    lines = F.transform(F.split(normalised(text), "\n"), lambda line: F.trim(line))
    return F.transform(
        F.array_remove(lines, ""),
        lambda line: F.struct(
            F.xxhash64(line).alias("h"), (F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).alias("w")
        ),
    )


def template_lines(profiled: DataFrame, limits: LineLimits) -> DataFrame:
    """``host``, ``h`` of the template lines. ``profiled`` has ``host`` and ``lines`` per document.

    Documents are distinct by their set of lines, so copies count once however many there are, and
    lines are distinct per document, so repeating a line counts once. Both are summed per task before
    they are shuffled: a line of a third of all documents is one row per task. The second count leaves
    out the documents that consist of such lines mostly.
    """
    sets = profiled.select("_row", "host", F.array_sort(F.array_distinct("lines")).alias("lines")).where(F.size("lines") > 0)
    kinds = sets.withColumn("kind", F.xxhash64("lines.h")).groupBy("host", "kind").agg(F.min("_row").alias("_row"), F.first("lines").alias("lines"))
    documents = stage(kinds.select("_row", "host", "lines"), "line-documents")
    hosts = documents.groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    lines = documents.select(
        "_row", "host", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0), lambda a, x: a + x["w"]).alias("n_words"),
        F.explode("lines").alias("line"),
    ).select("_row", "host", "n_lines", "n_words", "line.h", "line.w")
    counts = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limits.documents)
    common = counts.join(hosts, counts.host.eqNullSafe(hosts.host)).drop(hosts.host)
    least = F.least(limits.share * F.col("host_documents"), F.lit(float(limits.enough)))
    common = stage(common.where(F.col("n") >= least).select("host", "h", least.alias("least")), "common-lines")
    found = _with_common(lines, common).where(F.col("least").isNotNull())
    held = found.groupBy("_row", "host", "n_lines", "n_words").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("w").alias("words"), F.collect_list(F.struct("h", "least")).alias("held")
    )
    own = held.where((F.col("lines") <= limits.copied * F.col("n_lines")) | (F.col("words") <= limits.copied * F.col("n_words")))
    counted = own.select("host", F.explode("held").alias("x")).groupBy("host", "x.h", "x.least").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where((F.col("n") >= limits.documents) & (F.col("n") >= F.col("least"))).select("host", "h", F.lit(True).alias("is_template"))
    return stage(kept, "template-lines")


def _with_common(lines: DataFrame, common: DataFrame) -> DataFrame:
    """Look a (host, line) up; a missing host is a host of its own."""
    host = F.coalesce(F.col("host"), F.lit(""))
    named = common.withColumn("absent", F.col("host").isNull()).withColumn("host", host)
    keys = {"host": host, "absent": F.col("host").isNull(), "h": F.col("h")}
    return lookup_join(lines, named, keys, population=lines)


def line_verdicts(
    df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limits: LineLimits = LineLimits()
) -> DataFrame:
    """One row per row of ``df``: its key, the counts of ``base_rules``, ``base_failed``,
    ``n_template_words`` (words of its normalised lines that are template text) and ``kept``.

    Missing texts have no words and fail; a missing host is a host of its own; rows with a repeated
    or missing key are judged one by one; other columns are not read. An empty table gives none.
    """
    profiled = _profiled(df, key, text, host)
    judged = _judged(profiled, template_lines(profiled, limits), limits)
    return judged.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_template_words"
    )


def _profiled(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Staged: key, host, counts and line hashes of every row, with a row number that stays."""
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(host).alias("host"))
    rules = base_rules(rows, "_text").withColumn("lines", _line_array(F.col("_text"))).drop("_text")
    return stage(rules.withColumn("_row", F.monotonically_increasing_id()), "line-profiles")


def _judged(profiled: DataFrame, templates: DataFrame, limits: LineLimits) -> DataFrame:
    lines = profiled.select("_row", "host", F.explode("lines").alias("line")).select("_row", "host", "line.h", "line.w")
    marked = _with_common(lines, templates).where("is_template")
    removed = marked.groupBy("_row").agg(F.sum("w").alias("n_template_words"))
    counted = profiled.drop("lines", "host").join(removed, "_row", "left").withColumn(
        "n_template_words", F.coalesce("n_template_words", F.lit(0)).cast("bigint")
    )
    left = F.col("n_words") - F.col("n_template_words")
    return counted.withColumn("kept", ~F.col("base_failed") & (left >= limits.left * F.col("n_words")))


def clean_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limits: LineLimits = LineLimits()
) -> DataFrame:
    """The kept documents with all their columns, without their template lines.

    Rows with the same key, text and host share one verdict. Only the verdicts that change something
    return to the rows, by a lookup on key and text hash: rejections, and the template hashes of the
    documents that hold some. A missing text has no words and is rejected; a missing host is a host of
    its own; an empty table gives none. Columns may have any names.
    """
    mark = F.xxhash64(F.col(quoted(text)), F.col(quoted(host)))
    pairs = df.select(
        F.struct(F.col(quoted(key)).alias("k"), mark.alias("mark")).alias("_id"), F.col(quoted(text)).alias("_text"), F.col(quoted(host)).alias("_host")
    )
    profiled = _profiled(pairs, "_id", "_text", "_host")
    templates = template_lines(profiled, limits)
    lines = profiled.select("_row", "host", F.explode("lines.h").alias("h"))
    hits = _with_common(lines, templates).where("is_template").groupBy("_row").agg(F.collect_set("h").alias("hits"))
    judged = _judged(profiled, templates, limits).select("_row", "_id", "kept").join(hits, "_row", "left")
    gone = f"_hits_{uuid.uuid4().hex}"
    changed = judged.where("NOT kept OR hits IS NOT NULL").groupBy("_id").agg(
        F.first(F.when(F.col("kept"), F.col("hits")).otherwise(F.array().cast("array<bigint>"))).alias(gone)
    )
    table = stage(
        changed.select(F.coalesce(F.col("_id.k").cast("string"), F.lit("")).alias("k"), F.col("_id.mark").alias("mark"), gone), "line-verdicts"
    )
    keys = {"k": F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")), "mark": mark}
    # an empty list stands for a rejected document
    left = lookup_join(df, table, keys, broadcast_bytes=32 << 20, population=df).where(F.coalesce(F.size(gone) > 0, F.lit(True)))
    cleaned = F.when(F.col(gone).isNull(), F.col(quoted(text))).otherwise(
        F.array_join(
            F.filter(F.split(F.col(quoted(text)), "\n"), lambda line: ~F.array_contains(gone, F.xxhash64(F.trim(normalised(line))))),
            "\n",
        )
    )
    return left.select(*[cleaned.alias(c) if c == text else F.col(quoted(c)) for c in df.columns])
