"""Every stage of the pipeline on the whole table against a brute-force version of its rule, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from odd_rows import DOCS, SF_DIR
from test_near_duplicates import brute
from test_text_rules import brute_spans

import corpus_pipeline

SPACES = re.compile(r"[\x20\x09-\x0D]+")
TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def normal(line):
    return re.sub(r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def base_failed(text):
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p for i, w in enumerate(windows) if w in twice for p in range(i, i + 8)}
    return len(found) < 20 or 100 * len(covered) > 30 * len(found)


def quality(rows):
    """(id, text) that the quality rules keep: template lines by distinct line sets that are no copies of each other."""
    own = {}
    for r in rows:
        lines = frozenset(filter(None, map(normal, (r.text or "").split("\n"))))
        if lines:
            own.setdefault(r.source, set()).add(lines)
    templates = {}
    for host, sets in own.items():
        least = max(10, min(0.02 * len(sets), 500))
        common = {line for line, n in Counter(line for lines in sets for line in lines).items() if n >= least}
        size = lambda lines: sum(len(line.split(" ")) for line in lines)
        telling = [s for s in sets if 2 * len(s & common) <= len(s) or 2 * size(s & common) <= size(s)]
        templates[host] = {line for line, n in Counter(line for s in telling for line in s & common).items() if n >= least}
    kept = {}
    for r in rows:
        gone = templates.get(r.source, set())
        lost = sum(len(normal(line).split(" ")) for line in (r.text or "").split("\n") if normal(line) in gone)
        if not base_failed(r.text) and len(words(r.text)) - lost >= 0.3 * len(words(r.text)):
            kept[r.doc_id] = "\n".join(line for line in r.text.split("\n") if normal(line) not in gone)
    return kept


def contaminated(text, items):
    found = TOKENS.findall((text or "").translate(UP))
    hit = set()
    for item in items:
        own = TOKENS.findall((item or "").translate(UP))
        width = min(13, len(own))
        windows = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if own else set()
        for i in range(len(found) - width + 1 if own else 0):
            if tuple(found[i : i + width]) in windows:
                hit |= set(range(i, i + width))
    return bool(hit) and 20 * len(hit) >= len(found)


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        kept[name] = (docs.collect(), {r.doc_id: r for r in result.collect()}, result.columns)
        if name != "bpe":
            assert result.columns == docs.columns
            assert all(r.n_chars == len(r.text) for r in result.collect())
        docs = result
    before, after, _ = kept["quality_rules"]
    assert {n: r.text for n, r in after.items()} == quality(before)
    before, after, _ = kept["near_dedup"]
    assert {str(n) for n in after} == {key for key, _, _, keeps in brute([(r.doc_id, r.text) for r in before]) if keeps}
    assert all(after[r.doc_id].text == r.text for r in before if r.doc_id in after)
    before, after, _ = kept["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in before if contaminated(r.text, items)}
    assert bad and set(after) == {r.doc_id for r in before} - bad
    before, after, _ = kept["secret_scan"]
    assert set(after) == {r.doc_id for r in before}
    for r in before:
        spans = [tuple(map(int, span.split(":")[1:])) for span in brute_spans(r.text).split(",") if span]
        assert all(r.text[a:z] not in after[r.doc_id].text for a, z in spans)
        pieces = after[r.doc_id].text.split("[SECRET]")
        assert len(pieces) > 1 or not spans and after[r.doc_id].text == r.text
        at = 0
        for piece in pieces:  # what is left stands in the text, in order
            at = r.text.index(piece, at) + len(piece)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after, _ = kept["bpe"]
    assert set(after) == {r.doc_id for r in before}
    for r in before:
        assert list(after[r.doc_id].ids) == library.encode(r.text, add_special_tokens=False).ids
        assert after[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_documents(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = " ".join(word() for _ in range(60))
    rows = [(None, None), (1, None), (2, ""), (3, text), (3, text), (4, text + " token=abcdefgh12"), (None, " ".join(word() for _ in range(40)))]
    docs = spark.createDataFrame([(*row, None, None, "x", "x", 1, "x", "x") for row in rows], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        found = stage(spark, docs, SF_DIR)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "None"]


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
