"""Packing: exact round trip of ids, places without gaps or overlaps, bounded padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tariffscope.llm import packing
from tariffscope.llm.queries import TOKENIZER


def check(rows, texts, sequence):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    places, pieces = defaultdict(list), defaultdict(list)
    for row in rows:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
        pieces[row["doc_id"]].append(row)
    for used in places.values():
        end = 0
        for offset, length in sorted(used):
            assert offset == end and length > 0
            end += length
        assert end <= sequence
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for row in sorted(pieces[doc], key=lambda r: r["start"]):
            part = np.array(ids[at : at + row["length"]], "<u4").tobytes()
            assert (row["start"], row["ids_crc32"], row["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += row["length"]
        assert at == len(ids)
    return places


def test_round_trip(docs):
    draw = random.Random(2)
    texts = {k: " ".join(draw.choice(["The", "quick,", "brown", "föx", "don't", "日本", "x1"]) for _ in range(draw.randint(0, 400))) for k in range(60)}
    texts |= {100: None, 101: "", 102: "a<|endoftext|>b <|ENDOFTEXT|>", 103: "y" * 9000, 104: "É   é\x1cz ΑΣ", 105: texts[3]}
    table = docs([(k, t) for k, t in texts.items()])
    places = check(packing.pack(table, TOKENIZER, 256).collect(), texts, 256)
    total = sum(length for used in places.values() for _, length in used)
    assert total > 0.95 * 256 * len(places)
    assert packing.pack(docs([]), TOKENIZER).count() == 0


def test_repeated_rows_are_documents_of_their_own(docs):
    rows = packing.pack(docs([(5, "one two"), (5, "one two"), (None, "x")]), TOKENIZER).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in rows) == [(0, 2), (5, 3), (5, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_layout_uses_every_piece_once():
    draw = random.Random(4)
    for _ in range(20):
        histogram = {draw.randint(1, 64): draw.randint(1, 50) for _ in range(20)}
        patterns = packing.shortest_pack_first(histogram, 64)
        used = defaultdict(int)
        for pattern, count in patterns:
            assert sum(pattern) <= 64 and pattern == sorted(pattern, reverse=True)
            for length in pattern:
                used[length] += count
        assert used == histogram


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    ids = packing.WordIds(TOKENIZER)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for text in ("one two three four", "five six seven eight", "one six nine " + "z" * 200):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert ids.of([text.encode()]) == [want]
        assert len(ids.known) <= 8
