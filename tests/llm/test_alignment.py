"""Alignment of whole texts by the libraries, against the operator's words, vectors and pair counts."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from odd_rows import ODD, SF_DIR, docs  # noqa: F401
from stratafold.llm import alignment
from stratafold.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST = Tokenizer.from_file(A)
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=B)
BACK = {letter: byte for byte, letter in byte_letters().items()}
ALIGNER = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())


def a_bytes(number):
    return bytes(BACK[letter] for letter in FIRST.id_to_token(number))


def b_bytes(number):
    piece = SECOND.id_to_piece(number)
    return bytes([int(piece[3:5], 16)]) if SECOND.is_byte(number) else piece.replace("▁", " ").encode()


def whole(text):
    """Tokens of both sides with their byte ranges, encoded without cutting the text."""
    if not text:
        return None
    sides = []
    for ids, of in ((FIRST.encode(" " + text, add_special_tokens=False).ids, a_bytes), (SECOND.encode(text), b_bytes)):
        at, placed = 0, []
        for number in ids:
            placed.append((number, at, at + len(of(number))))
            at = placed[-1][2]
        if b"".join(map(of, ids)) != (" " + text).encode():
            return None
        sides.append(placed)
    return sides


def brute(texts):
    found = [whole(text) for text in texts]
    links = [
        [(x, y) for x, s, e in sides[0] for y, p, q in sides[1] if s < q and p < e] if sides else [] for sides in found
    ]
    counts = Counter(pair for held in links for pair in held)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    rows = []
    for sides, held in zip(found, links):
        if not sides:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(n) for n, s, e in side if start <= s and e <= end) for side in sides))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append((
            len(sides[0]), len(sides[1]), len(ends), len(held), sum(counts[p] == most[p[1]] for p in held), sum(counts[p] for p in held), digest,
        ))
    return rows


def found(df):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(tuple(map(str, (r[c] for c in columns))) for r in alignment.align(df, A, B).collect())


def expected(rows):
    return sorted(tuple(map(str, (key, *made))) for (key, *_), made in zip(rows, brute([text for _, text, *_ in rows])))


def test_whole_table_in_both_joins(spark, monkeypatch):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").where("length(text) < 6000")
    rows = expected([(r.doc_id, r.text) for r in table.collect()])
    assert found(table) == rows
    monkeypatch.setattr(alignment, "BROADCAST", 0)
    monkeypatch.setattr(alignment, "SLICE", 500)
    assert found(table.repartition(5)) == rows


def test_odd_rows(docs):
    rows = ODD + [
        (11, "tab\t b \n c  d\n  e"), (12, "▁ marks ▁"), (13, "<|endoftext|> <s> </s> <unk> <0x0A>"), (14, "漢字 é́ \U0001f469‍\U0001f467 12½"),
        (15, " "), (16, " lead and trail "), (17, "x" * 20000 + " y"), (18, "a\x00b \x00"), (18, "same words here"), (18, "same words here"), (19, "　　 a　 b"),
    ]
    assert found(docs(rows)) == expected(rows)
    assert found(docs([])) == [] and found(docs([(1, None)])) == expected([(1, None)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'stll▁\x1c\x85 　"))), max_size=4))
def test_texts_have_the_libraries_tokens(texts):
    found = ALIGNER.align(texts)
    assert len(found.groups) == len(texts)
    for place, text in enumerate(texts):
        sides = whole(text) or ([], [])
        groups = [g.split("|") for g in found.groups[place].split(";")] if found.groups[place] else []
        for side in (0, 1):
            assert [n for n, _, _ in sides[side]] == [int(n) for g in groups for n in g[side].split(",")]
        assert (found.n_a[place], found.n_b[place], found.n_groups[place]) == (len(sides[0]), len(sides[1]), len(groups))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \t\nab▁  ")), min_size=1))
def test_pieces_of_long_texts_have_the_same_tokens(text):
    before, alignment.LONGEST = alignment.LONGEST, 3
    try:
        assert ALIGNER.tokens(text) == ((lambda s: s and tuple([n for n, _, _ in side] for side in s))(whole(text)))
    finally:
        alignment.LONGEST = before


def test_identity_map_leads_to_equal_bytes():
    same = ALIGNER.same
    assert (same >= 0).sum() > 10_000
    for number in range(0, 50_000, 97):
        held = [n for n in range(32_000) if b_bytes(n) == a_bytes(number)] if number < 2000 else None
        if same[number] >= 0:
            assert b_bytes(int(same[number])) == a_bytes(number)
        elif held is not None:
            assert not held


def test_long_words():
    found = ALIGNER.align(["x" * 300_000 + " y", "é" * 20_000])
    assert found.n_groups.min() > 0 and found.n_a[0] > 1000


def test_ids_in_another_order_go_to_the_other_library():
    import json

    parsed = json.loads(open(A, encoding="utf-8").read())
    entries = parsed["model"]["vocab"]
    one, two = (token for token, number in entries.items() if number in (1000, 2000))
    entries[one], entries[two] = entries[two], entries[one]
    back = {number: token for token, number in entries.items()}
    other = alignment.ByteTokens(json.dumps(parsed))
    for text in (" some words, and 12 more!", "  é \n x"):
        assert [back[n] for n in other.encode(text)] == FIRST.encode(text, add_special_tokens=False).tokens
        assert b"".join(other.bytes[n] for n in other.encode(text)) == text.encode()
