"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 32 bytes says so, so equal passages of different documents fall
into equal chunks wherever they stand. A task encodes each distinct chunk once and reuses its ids (a cache of
bounded size; what falls out is encoded again, with the same result). Tokens at a chunk's ends can differ from
those of the whole text, so every join is repaired: the stretch from the last certain boundary before the join to
the first certain one after it is encoded again, and widened until its ends agree with token boundaries of both
chunks. A boundary is certain where a letter is followed by one space and a letter: no pre-token crosses it, in
the text or in any stretch of it that holds these three characters, so the joined ids are those of the whole text.

The vocabulary file is a parameter: a `tokenizers` JSON file of a byte-level BPE that splits by the library's own
pattern and whose ids follow the order of its merges; others are refused (`supported`). Special
tokens that stand in a text get their own id, as the tokenizers library does; nothing is added, cut or padded.

Defined results: null text is encoded as the empty text (0 tokens). Bytes that aren't UTF-8 become U+FFFD. Other
columns, also ones named like the new columns, are kept by `encode` unless they have a new column's name.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared as H

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 32
MEAN_BITS = 11  # a cut every 2,048 bytes on average
LEAST, MOST = 256, 1 << 16
CACHE_BYTES = 24 << 20  # of chunk bytes and ids, per task

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def supported(spec: dict) -> None:
    """Raise ValueError unless the file is a byte-level BPE that this codec encodes as the tokenizers library does."""
    model, pre, decoder = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    wrong = [name for name, bad in {
        "model.type": model.get("type", "BPE") != "BPE",
        "normalizer": bool(spec.get("normalizer")),
        "post_processor": bool(spec.get("post_processor")),
        "pre_tokenizer": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") is not False or pre.get("use_regex", True) is not True,
        "decoder": decoder.get("type") != "ByteLevel",
        "added_tokens": any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }.items() if bad]
    wrong += [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    vocab, merges = model.get("vocab") or {}, model.get("merges") or []
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in merges]
    if any(a >= b for a, b in zip([-1, *made], made)):  # ids stand for the order of merges
        wrong.append("model.merges: not in the order of the ids")
    if len(set(made)) + 256 != len(set(vocab.values()) - {t["id"] for t in spec.get("added_tokens", ())}):
        wrong.append("model.vocab: not 256 bytes and the merges")
    if wrong:
        raise ValueError("not a byte-level BPE of the supported kind: " + ", ".join(wrong))


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        supported(spec)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(x): x for x in printable}
        to_byte |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(printable))}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        ids = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        self.path = path
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={b: i for i, b in ids.items()}, special_tokens={})
        ids |= {i: b for b, i in self.special.items()}
        n = max(ids) + 1
        self.bytes = np.array([ids.get(i, b"") for i in range(n)], object)
        self.decimal = np.array([str(i).encode() for i in range(n)], object)
        self.width = np.array([len(ids.get(i, b"")) for i in range(n)], np.int64)
        self.cache: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def plain(self, raw: bytes) -> np.ndarray:
        """Ids of a stretch, without special tokens and without cutting it."""
        text = raw.decode("utf-8", "replace")
        try:
            return np.asarray(self.fast.encode_ordinary(text), np.int32)
        except BaseException as e:  # the fast library gives up on very long runs of white space
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self._slow(text)

    def _slow(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True
        return np.asarray(t.encode(text, add_special_tokens=False).ids, np.int32)

    def chunk(self, raw: bytes) -> np.ndarray:
        got = self.cache.get(raw)
        if got is not None:
            self.reused += 1
            return got
        got = self.plain(raw)
        self.encoded += 1
        size = len(raw) + got.nbytes + 200
        while self.cache and self.held + size > CACHE_BYTES:  # oldest first
            old = next(iter(self.cache))
            self.held -= len(old) + self.cache.pop(old).nbytes + 200
        if size <= CACHE_BYTES:
            self.cache[raw] = got
            self.held += size
        return got

    def joined(self, raw: bytes) -> np.ndarray:
        """Ids of a stretch without special tokens, from chunks."""
        b = np.frombuffer(raw, np.uint8)
        edges = cuts(b)
        if len(edges) == 2:
            return self.chunk(raw)
        certain = np.flatnonzero(_LETTER[b[:-2]] & (b[1:-1] == 32) & _LETTER[b[2:]]) + 1
        lo, hi = np.searchsorted(certain, edges[:-1] + 1), np.searchsorted(certain, edges[1:] - 1)
        out, start = [], 0  # start: from where on the text isn't encoded yet
        last = len(edges) - 2
        for j in range(last + 1):
            s, e = int(edges[j]), int(edges[j + 1])
            points = certain[lo[j] : hi[j]]
            if len(points) + (j == 0) + (j == last) < 2:
                continue  # no stretch of this chunk is certain: the repair passes over it
            ids = self.chunk(raw[s:e])
            ends = np.cumsum(self.width[ids]) + s
            first = self._agreed(points, ends, s, 1) if j else s
            stop = self._agreed(points, ends, s, -1) if j < last else e
            if first is None or stop is None or first >= stop:
                continue
            if start < first:
                out.append(self.plain(raw[start:first]))
            out.append(ids[np.searchsorted(ends, first, side="right") if first > s else 0 : np.searchsorted(ends, stop, side="right")])
            start = stop
        if start < len(raw):
            out.append(self.plain(raw[start:]))
        return np.concatenate(out)

    @staticmethod
    def _agreed(points: np.ndarray, ends: np.ndarray, s: int, step: int) -> int | None:
        """The outermost certain boundary that is a token boundary of the chunk; inner ones are tried until one agrees."""
        for p in points[::step]:
            i = np.searchsorted(ends, p)
            if i < len(ends) and ends[i] == p:
                return int(p)
        return None

    def encode(self, raw: bytes) -> np.ndarray:
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        parts = [raw]
        for token, i in self.special.items():
            parts = [y for x in parts for y in (_split(x, token, i) if isinstance(x, bytes) else [x])]
        ids = [self.joined(x) if isinstance(x, bytes) else np.array([x], np.int32) for x in parts if x != b""]
        return np.concatenate(ids) if ids else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        raw = b"".join(self.bytes[ids].tolist())
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


def _split(raw: bytes, token: bytes, i: int) -> list:
    pieces = raw.split(token)
    return [y for k, x in enumerate(pieces) for y in ([i, x] if k else [x])]


def cuts(b: np.ndarray) -> np.ndarray:
    """Chunk edges of UTF-8 bytes, 0 and len(b) included; each edge is at the start of a character."""
    n = len(b)
    if n <= 2 * LEAST:
        return np.array([0, n])
    h, w = H.BYTE_CODES[b], 1
    while w < WINDOW:
        h = H.doubled(h, w)
        w *= 2
    at = np.flatnonzero(H.splitmix(h) >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW
    out = [0]
    for p in [*at.tolist(), n]:
        while p - out[-1] > MOST:
            out.append(_character(b, out[-1] + MOST // 2))
        if p - out[-1] >= LEAST and n - p >= LEAST and (b[p] & 0xC0) != 0x80:
            out.append(p)
    return np.array([*out, n])


def _character(b: np.ndarray, p: int) -> int:
    while (b[p] & 0xC0) == 0x80:
        p -= 1
    return p


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def _digests(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            n, enc, dec = [], [], []
            for raw in _raw(batch, "text"):
                ids = c.encode(raw)
                n.append(len(ids))
                enc.append(hashlib.sha256(b",".join(c.decimal[ids].tolist())).hexdigest())
                dec.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digest(docs: DataFrame, path: str) -> DataFrame:
    return H.in_small_batches(docs).selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoder(path: str, keep: list[str]):
    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(raw) for raw in _raw(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "n_tokens", "token_ids"]
            )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens and token_ids; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "token_ids")]
    kept = H.in_small_batches(docs).select(*[f"`{c}`" for c in keep])
    return kept.mapInArrow(_encoder(path, keep), f"{_ddl(kept)}, n_tokens long, token_ids array<int>")


def _decoder(path: str, keep: list[str]):
    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("token_ids"))
            text = [c.decode(np.asarray(x.values, np.int32)).decode() if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(text, pa.string())], names=[*keep, "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with text decoded from token_ids (null ids: null); a column named text is replaced."""
    keep = [c for c in tokens.columns if c != "text"]
    kept = tokens.select(*[f"`{c}`" for c in keep])
    return kept.mapInArrow(_decoder(path, keep), f"{_ddl(kept)}, text string")


def _transcoder(path: str, keep: list[str]):
    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(raw) for raw in _raw(batch, "text")]
            text = pa.array([c.decode(x).decode() for x in ids], pa.string())
            cols = [text if k == "text" else batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "n_tokens", "token_ids"])

    return run


def transcode(docs: DataFrame, path: str) -> DataFrame:
    """`encode` and `decode` in one pass: docs with n_tokens and token_ids, and text as the ids decode to it."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "token_ids")]
    kept = H.in_small_batches(docs).select(*[f"`{c}`" for c in keep])
    return kept.mapInArrow(_transcoder(path, keep), f"{_ddl(kept)}, n_tokens long, token_ids array<int>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
