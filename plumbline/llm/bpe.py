"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library splits and merges; its vocabulary spells each byte as one printable character, so the table of
those characters (built from the rule below) leads from characters to bytes and back. Token offsets follow from the
byte lengths of the tokens: they are given in bytes and, by the byte-to-character map of the text, in characters. A
token may begin or end inside a character; its character offsets then cover every character that it touches, and
decoding reverses the table for every token and joins the bytes of all of them before it reads characters.

Nulls: a null text is encoded as an empty one; null ids decode to null. All other columns pass through untouched.
Repeated rows are encoded one by one; a text of any length is encoded as a whole.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extend, table

RANKS, LIBRARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 1 << 19


def vocabulary(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The character that spells each byte: itself if printable in Latin-1, else the next unused one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spell = {b: chr(b) for b in plain}
    for b in range(256):
        spell.setdefault(b, chr(0x100 + len(spell) - len(plain)))
    return [spell[b] for b in range(256)]


@lru_cache(2)
def _codec(ranks_file: str, library_file: str):
    """The tokenizer, its tokens' bytes by rank, and their lengths. The two files must spell one vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's other cores have tasks of their own
    from tokenizers import Tokenizer

    with open(vocabulary(ranks_file), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    with open(vocabulary(library_file), encoding="utf-8") as f:
        spelled = json.load(f)
    tokenizer = Tokenizer.from_file(vocabulary(library_file))
    tokenizer.encode_special_tokens = True
    special = {t["content"] for t in spelled.get("added_tokens", ())}
    pieces = spelled_bytes({t: i for t, i in spelled["model"]["vocab"].items() if t not in special})
    if wrong := [t for t, i in ranks.items() if i >= len(pieces) or pieces[i] != t] or [p for p in pieces if p and p not in ranks]:
        raise ValueError(f"{ranks_file} and {library_file} differ at {wrong[0]!r}")
    return tokenizer, pieces, np.array([len(p) for p in pieces], np.int64)


def spelled_bytes(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of every token by its id: the byte alphabet reversed, character by character."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    pieces = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(back[c] for c in token)
    return pieces


def _offsets(data: np.ndarray, at: np.ndarray, ids: np.ndarray, first: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a step: character start and end of each token within its text, and for each text the number of its
    tokens that end inside a character. Text k has the tokens from first[k] to first[k + 1].
    """
    ends = np.cumsum(widths[ids])  # the tokens' bytes are the texts' bytes, end to end
    starts = ends - widths[ids]
    opens = (data & 0xC0) != 0x80  # the first byte of each character
    char = np.concatenate([[0], np.cumsum(opens)])
    origin = np.repeat(char[at[:-1]], np.diff(first))
    split = np.concatenate([[0], np.cumsum(~np.append(opens, True)[ends])])
    return (char[starts + 1] - 1 - origin).astype(np.int32), (char[ends] - origin).astype(np.int32), np.diff(split[first])


def encode(df: DataFrame, text_col: str = "text", offsets: bool = False, drop: tuple[str, ...] = (), ranks_file: str = RANKS, library_file: str = LIBRARY) -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit integers, as binary) and ``n_tokens``; with ``offsets`` also
    ``starts``, ``ends`` (arrays: characters of the text) and ``n_split`` (tokens that end inside a character).
    Columns of ``drop`` are not returned.
    """
    more = "ids binary, n_tokens long" + ", starts array<int>, ends array<int>, n_split long" * offsets

    def make():
        tokenizer, _, widths = _codec(ranks_file, library_file)

        def work(part, data, at):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            ids = [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = [i.size for i in ids]
            cols = [pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(sizes, pa.int64())]
            if offsets:
                first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                starts, ends, split = _offsets(data, at, np.concatenate([*ids, np.zeros(0, "<u4")]), first, widths)
                cols += [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (starts, ends)] + [pa.array(split)]
            return cols

        return work

    return extend(df, make, more, text_col, ENCODE_BYTES, drop)


def decode(df: DataFrame, ids_col: str = "ids", ranks_file: str = RANKS, library_file: str = LIBRARY) -> DataFrame:
    """Adds ``decoded``: the bytes of all tokens, joined. Cast it to string to read characters."""

    def make():
        _, pieces, _ = _codec(ranks_file, library_file)

        def work(part, data, at):
            return [pa.array([None if x is None else b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column(ids_col).to_pylist()], pa.binary())]

        return work

    return extend(df, make, "decoded binary", ids_col, 4 * ENCODE_BYTES)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the columns asked for: the number of tokens that end inside a character, and the end of the last token's
    characters, which is the text's length.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    last = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long")
    coded = encode(docs, offsets=True, drop=("text",)).select("doc_id", "n_tokens", "ids", "n_split", last.alias("n_chars"))
    return decode(coded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split", "n_chars")
