"""Every query with SQL against that SQL, on the given tables and on hand-made rows that meet every rule."""

import random
import textwrap

import pytest
from comparison import differences, sql_engine

from stratafold.llm.catalog import registered
from stratafold.llm.licenses import TEMPLATES
from stratafold.llm.oracle import oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registered(), oracle()


@pytest.fixture(scope="module")
def engine():
    return sql_engine(SF_DIR)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, engine, name):
    assert differences(QUERIES[name](spark, SF_DIR), SQL[name], engine) == []


def test_decontamination_does_not_depend_on_width(spark, engine, partitions):
    partitions(13)
    assert differences(QUERIES["op6_decontaminate"](spark, SF_DIR), SQL["op6_decontaminate"], engine) == []


def letters(n):
    return chr(97 + n // 676 % 26) + chr(97 + n // 26 % 26) + chr(97 + n % 26)


def own_words(n, k=30):
    return " ".join(f"d{letters(n)}x{letters(i)}" for i in range(k))


def quality_rows():
    """Footers of several lines, near copies, copies, a repeated line, depleted texts, missing hosts and texts."""
    footer = "About this site\nAll rights reserved 12\n  Powered by\ta tool"
    rows = [(f"{own_words(n)}\n{footer}", "footer") for n in range(14)]
    rows += [(own_words(50) + "\nAll rights reserved 7" * 40, "footer"), (own_words(51), "footer")]
    lines = [own_words(60 + k, 12) for k in range(8)]
    rows += [("\n".join(lines[: n % 8] + [own_words(100 + n, 12)] + lines[n % 8 + 1 :]), "near") for n in range(40)]
    rows += [("copied first line\n" + own_words(200), "copies")] * 15 + [("copied first line\n" + own_words(201 + n), "copies") for n in range(11)]
    rows += [(own_words(300) + f"\nown{letters(n)} word{letters(n)}", "depleted") for n in range(12)]
    rows += [(f"Same header\n{own_words(400 + n)}", None) for n in range(11)]
    rows += [(f"rare header\n{own_words(500 + n)}", "large") for n in range(10)] + [(own_words(600 + n), "large") for n in range(700)]
    return rows + [(None, None), ("", "footer"), (" \n\t", "near"), ("one " * 30, "near"), (f"{own_words(1, 25)} {own_words(1, 25)}", "near")]


def license_rows():
    """Templates on one line, wrapped at several widths with and without marks, cut short and mixed with other words."""
    rng = random.Random(3)
    rows = []
    for at, (_, text) in enumerate(TEMPLATES):
        words = text.split()
        for width, mark in ((500, ""), (40, " * "), (25, "# "), (70, "// ")):
            rows.append("int x;\n" + "\n".join(mark + line for line in textwrap.wrap("Copyright A. " + text.title() + " and more", width)))
        for left in (0.7, 0.79, 0.85):
            held = [w for w in words if rng.random() < left]
            rows += [" ".join(held), "\n".join(held), "\n".join(f"{w} filler" for w in held)]
        rows.append(" ".join(words[: len(words) // 2]) + "\n" + own_words(at, 40) + "\n" + " ".join(words[len(words) // 2 :]))
    return [(text, "s") for text in [*rows, None, "", "MIT-License; cc by\nGNU general PUBLIC license", own_words(1)]]


@pytest.mark.parametrize("name,rows", [("op4_line_quality", quality_rows()), ("op9_licenses", license_rows())])
def test_hand_made_rows_equal_sql(spark, tmp_path, name, rows):
    docs = spark.createDataFrame([(n, text, "en", host, len(text or "")) for n, (text, host) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    assert differences(QUERIES[name](spark, str(tmp_path)), SQL[name], sql_engine(str(tmp_path))) == []
    found = QUERIES[name](spark, str(tmp_path))
    rule = "n_template_words > 0" if name.startswith("op4") else "labels <> base_labels"
    assert found.where(rule).count() > 20
