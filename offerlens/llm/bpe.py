"""BPE encoding and decoding through a table of distinct words (operator 4).

Words, as the byte-level pre-tokenizer splits them, repeat; a text's ids are its words' ids in order.  So each block of
documents deals its distinct words into parts by hash; a part of all blocks' words is a part of the distinct-word table.
There each distinct word is encoded once, by the vocabulary's own merges, and its ids are joined to the table of pieces
they stand for.  Both go back to the blocks that asked and are put together by position.  There are as many parts as
the size of all texts asks for, so a part is bounded whatever the input; what a block has of a part travels as one
compressed row, as a row for each word takes twice the space.  The word table is never broadcast: invented words grow
with the corpus.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from offerlens.llm import blocks

# The published split pattern of the byte-level vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(2)
def piece_table(path: str) -> pd.DataFrame:
    """(id, piece): the bytes that each id of the vocabulary stands for."""
    tokenizer = load(path)
    alphabet, special = byte_alphabet(), {a.content for a in tokenizer.get_added_tokens_decoder().values()}
    rows = [(i, piece.encode() if piece in special else bytes(alphabet[c] for c in piece)) for piece, i in tokenizer.get_vocab().items()]
    return pd.DataFrame(rows, columns=["id", "piece"])


def encoded_words(words: list[str], path: str) -> tuple[list[list[int]], list[bytes]]:
    """The ids of each word, and what they decode to through a join with the pieces."""
    ids = [e.ids for e in load(path).encode_batch(words, add_special_tokens=False)]
    flat = pd.DataFrame({"id": np.fromiter(chain.from_iterable(ids), np.int64)})
    pieces = flat.merge(piece_table(path), on="id", how="left")["piece"].tolist()
    ends = np.cumsum([len(x) for x in ids]).tolist()
    return ids, [b"".join(pieces[e - len(x) : e]) for x, e in zip(ids, ends, strict=True)]


def splitter(tokenizer):
    """A function from a text to its words; added tokens, which the tokenizer takes out of a text first, are words too.

    The pattern serves texts up to U+024F.  Beyond that the classes of newer Unicode versions may differ, so the
    tokenizer's own pre-tokenizer splits those texts.
    """
    added = sorted((a.content for a in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    words, beyond, own = regex.compile(SPLIT).findall, regex.compile(r"[^\x00-\u024f]").search, tokenizer.pre_tokenizer.pre_tokenize_str
    cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def plain(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in own(text)] if beyond(text) else words(text)

    def split(text: str) -> list[str]:
        if not any(a in text for a in added):
            return plain(text)
        return [w for part in cut.split(text) if part for w in ([part] if part in added else plain(part))]

    return split


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and the text they decode to.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text in
    UTF-8) and, if asked for, ids array<int> and decoded string.  Null and empty texts have no ids and decode to the
    empty text.  Repeated rows each get a row; an empty table gives an empty result; other columns of docs are not read.
    path must be readable on every executor; it is a file of the environment, like the library itself.
    """
    parts = blocks.parts_of(docs, text_col)
    held = blocks.packed(docs, id_col, text_col)

    def numbered(b: blocks.Block) -> tuple[dict[str, int], list[np.ndarray], dict[int, list[str]]]:
        """The block's distinct words, each text as their numbers, and the words by part, in the same order at each call."""
        split, seen, dealt = splitter(load(path)), {}, {}
        texts = [np.array([seen.setdefault(w, len(seen)) for w in split(text)], np.int32) for text in b.texts()]
        for w in sorted(seen):
            dealt.setdefault(crc32(w.encode()) % parts, []).append(w)
        return seen, texts, dealt

    def ask(block: int, b: blocks.Block):
        rows = []
        for part, words in numbered(b)[2].items():
            raw = [w.encode() for w in words]
            rows.append((block, part, blocks.squeeze(np.array([len(r) for r in raw], np.uint32), np.frombuffer(b"".join(raw), np.uint8))))
        yield pd.DataFrame(rows, columns=["block", "part", "words"])

    def answer(key, asked):
        lists = []
        for data in asked["words"]:
            sizes, raw = blocks.spread(data, np.uint32, np.uint8)
            raw, ends = raw.tobytes(), np.cumsum(sizes.astype(np.int64))
            lists.append([raw[e - s : e].decode() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
        distinct = sorted(set().union(*lists))
        table = dict(zip(distinct, zip(*encoded_words(distinct, path), strict=True), strict=True))
        out = []
        for block, words in zip(asked["block"], lists, strict=True):
            own = [table[w] for w in words]
            # as most words decode to themselves, only others are sent
            other = [i for i, w in enumerate(words) if own[i][1] != w.encode()]
            raw = [own[i][1] for i in other]
            out.append((block, key[0], blocks.squeeze(np.array([len(ids) for ids, _ in own], np.uint32), np.array([i for ids, _ in own for i in ids], np.uint32), np.array(other, np.uint32), np.array([len(r) for r in raw], np.uint32), np.frombuffer(b"".join(raw), np.uint8))))
        return pd.DataFrame(out, columns=["block", "part", "ids"])

    def join(block: int, b: blocks.Block, answers: pd.DataFrame) -> pd.DataFrame:
        seen, texts, dealt = numbered(b)
        text_of, bytes_of = [""] * len(seen), [w.encode() for w in seen]
        for part, data in zip(answers["part"], answers["ids"], strict=True):
            counts, ids, other, sizes, raw = blocks.spread(data, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8)
            words, ids, raw, at = dealt[part], ids.tolist(), raw.tobytes(), 0
            for w, c in zip(words, counts.tolist(), strict=True):
                text_of[seen[w]] = ",".join(map(str, ids[at : at + c]))
                at += c
            for i, e, n in zip(other.tolist(), np.cumsum(sizes.astype(np.int64)).tolist(), sizes.tolist(), strict=True):
                bytes_of[seen[words[i]]] = raw[e - n : e]
        rows = []
        for doc, numbers in zip(b.doc_ids(), texts, strict=True):
            words = numbers.tolist()
            ids = ",".join([text_of[i] for i in words])
            decoded = b"".join([bytes_of[i] for i in words]).decode("utf-8", "replace").encode()
            rows.append((doc, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()) + (([int(i) for i in ids.split(",")] if ids else [], decoded.decode()) if with_ids else ()))
        return pd.DataFrame(rows, columns=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    asked = blocks.each(held, ask, "block long, part long, words binary")
    answers = asked.groupBy("part").applyInPandas(answer, "block long, part long, ids binary")
    return blocks.answered(held, answers, join, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
