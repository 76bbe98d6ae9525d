from __future__ import annotations

import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import packing

SCHEMA = "doc_id long, text string, start int"


def test_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None, 0), (2, "", 0), (3, "Hello wörld  again\n" * 900, 0), (4, "x", 0), (4, "x", 0), (5, "a b c " * 37, 0)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), tokenizer=path).collect()
    ids = {d: Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [2] for d, t, _ in rows}
    for d, own in ids.items():
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(own) * sum(x[0] == d for x in rows)
        for r in mine:
            part = b"".join(i.to_bytes(4, "little") for i in own[r.start : r.start + r.length])
            assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(own)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer=path).count() == 0


def test_nulls_long_words_clashing_names_and_padding(spark):
    path, schema = public_tokenizers.path("word_bpe_49k.json"), "doc_id long, text string, class string, part int, at int, ids string"
    rows = [(None, "a null id"), (None, "a null id"), (None, None), (7, "x" * 5000), (8, "é" * 70 + " " + "漢" * 100), (9, " \n\t ")] + [(100 + i, "word and more " * (i * 13 % 200)) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "c", 1, 2, "") for d, t in rows], schema)
    tokens = Tokenizer.from_file(path)
    want = [len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    for parts in (1, 5):
        got = packing.pack(docs.repartition(parts), tokenizer=path).collect()
        assert sum(r.length for r in got) == sum(want) and sorted(r.doc_tokens for r in got if r.start == 0) == sorted(want)
        assert sum(r.doc_id is None for r in got if r.start == 0) == 3
        filled = {}
        for r in got:
            filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
        assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= 4096
        # Full sequences, but for the room that classes leave and the last one of each.
        assert len(filled) * 4096 <= sum(want) * 1.1 + 4096 * (packing.CLASSES + 1)


def _own(tokens: Tokenizer, text: str) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in tokens.encode(text, add_special_tokens=False).ids)


def test_encoder_gives_the_ids_of_the_whole_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, encoder = Tokenizer.from_file(path), packing._Encoder(path)
    assert encoder.by_word
    letters = [chr(i) for i in [*range(1, 0x250), 0x301, 0x308, 0x345, 0x3A3, 0x1E9E, 0x2028, 0x212A, 0x3000, 0xAC00, 0xFB01, 0xE000, 0x1F600]]
    texts = [f"{c} {c}{c} a{c}b {c}'S'start{c}9{c}! I{c} '{c}ll" for c in letters]
    signs = random.Random(7)
    common = "abtheTHE'sSld0189,.!?&#%'-_|<>~éÉßüñÿŸŒœſĸŉ İ́\x1c\x85\xa0"
    texts += ["".join(signs.choices(common, k=signs.randrange(1, 60))) for _ in range(4000)]
    texts += ["x<|endoftext|>Y <|startoftext|> <|ENDOFTEXT|> <|end oftext|>", "a\0b \x7f", "", "Größenordnung" * 400, "&&'s 'S ''re 'VE'm"]
    for text in texts:
        assert encoder.ids(text.encode()) == _own(tokens, text), text


def test_plain_words_of_known_parts_do_without_the_tokenizer(monkeypatch):
    encoder = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    monkeypatch.setattr(encoder.parts, "model", _Asked(encoder.parts.model, asked))
    monkeypatch.setattr(encoder, "whole", lambda text: asked.append(text))
    encoder.ids("Straße , . ### word".encode())
    assert sorted(asked) == sorted(["straÃŁe", ",", ".", "###", "word"])
    encoder.ids("straße, Straße. WORD### word,straße ###Word".encode())
    assert len(asked) == 5


class _Asked:
    def __init__(self, model, asked: list[str]) -> None:
        self.model, self.asked = model, asked

    def tokenize(self, part: str):
        self.asked.append(part)
        return self.model.tokenize(part)


def test_caches_that_are_full_start_afresh(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    monkeypatch.setattr(packing, "CACHED_PARTS", 2)
    tokens, encoder = Tokenizer.from_file(path), packing._Encoder(path)
    text = "one two, three. Four five6 " * 3 + "y" * 500
    assert encoder.ids(text.encode()) == _own(tokens, text) and len(encoder) <= 3 and len(encoder.parts) <= 2


def test_tokenizers_that_join_across_white_space(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, texts = Tokenizer.from_file(path), {1: "Two words,\n\n  and more", 2: "", 3: "a  b"}
    assert not packing._Encoder(path).by_word
    got = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer=path, capacity=1, classes=1).collect()
    for doc, text in texts.items():
        mine = sorted((r.start, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == doc)
        own = tokens.encode(text, add_special_tokens=False).ids + [2]
        assert mine == [(k, zlib.crc32(i.to_bytes(4, "little")), len(own)) for k, i in enumerate(own)]
