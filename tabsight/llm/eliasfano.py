"""Compact integer sequences in numpy: packed integers, Elias-Fano monotone sequences, and files of arrays to map."""

from __future__ import annotations

import json
import tempfile

import numpy as np
from pyarrow import fs

U1, U6, U63, U64 = np.uint64(1), np.uint64(6), np.uint64(63), np.uint64(64)
#: Place of the k-th set bit in each byte.
_PLACE = np.array([[([b for b in range(8) if x >> b & 1] + [8] * 8)[k] for k in range(8)] for x in range(256)], np.uint8)
#: A one, and the highest bit, in each byte of a word.
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``values`` below 2^bits side by side in 64-bit words (two spare words at the end)."""
    values = values.astype(np.uint64)
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
    word, off = (at >> U6).astype(np.int64), at & U63
    words = np.zeros((len(values) * bits + 63) // 64 + 2, np.uint64)
    np.bitwise_or.at(words, word, values << off)
    over = off + np.uint64(bits) > U64
    np.bitwise_or.at(words, word[over] + 1, values[over] >> (U64 - off[over]))
    return words


def unpack(words: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    at = index.astype(np.uint64) * np.uint64(bits)
    word, off = (at >> U6).astype(np.int64), at & U63
    high = np.where(off > 0, words[word + 1] << ((U64 - off) & U63), np.uint64(0))
    return ((words[word] >> off) | high) & np.uint64((1 << bits) - 1)


def ef_encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence: low bits packed, high bits in unary, and the ones before each word of the unary part."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    bits = max(1, (top // max(n, 1)).bit_length())
    values = values.astype(np.uint64)
    place = ((values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
    high = np.zeros((place[-1] // 64 + 1) if n else 1, np.uint64)
    np.bitwise_or.at(high, place >> 6, U1 << (place & 63).astype(np.uint64))
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]])
    low = pack(values & np.uint64((1 << bits) - 1), bits)
    return {"low": low, "high": high, "before": before, "bits": np.array([bits], np.int64)}


def ef_access(ef: dict[str, np.ndarray], index: np.ndarray) -> np.ndarray:
    """Values at ``index``: the high part is the place of the index-th one, less the ones before it."""
    word = np.searchsorted(ef["before"], index, "right") - 1
    place = (word << 6) + _select(ef["high"][word], (index - ef["before"][word]).astype(np.uint64))
    return _value(ef, place, index)


def _value(ef: dict[str, np.ndarray], place: np.ndarray, index: np.ndarray) -> np.ndarray:
    bits = int(ef["bits"][0])
    return ((place - index).astype(np.uint64) << np.uint64(bits) | unpack(ef["low"], index, bits)).astype(np.int64)


def ef_ranges(ef: dict[str, np.ndarray], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values at ``index`` and at the places after it, which there must be."""
    high, before = ef["high"], ef["before"]
    word = np.searchsorted(before, index, "right") - 1
    own, left = high[word], (index - before[word]).astype(np.uint64)
    first = (word << 6) + _select(own, left)
    # the next one is the lowest above it, in this word or in the next that has any
    rest = own & (~np.uint64(0) << (first & 63).astype(np.uint64) << U1)
    none = np.flatnonzero(rest == 0)
    if len(none):
        word[none] = np.searchsorted(before, index[none] + 1, "right") - 1
        rest[none] = high[word[none]]
    second = (word << 6) + np.bitwise_count((rest & (~rest + U1)) - U1)
    return _value(ef, first, index), _value(ef, second, index + 1)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one, from 0, in each word: sums of ones up to each byte, side by side in a word, tell the byte."""
    n = words - ((words >> U1) & np.uint64(0x5555555555555555))
    n = (n & np.uint64(0x3333333333333333)) + ((n >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((n + (n >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    octet = np.bitwise_count((((k * _BYTES) | _TOPS) - upto) & _TOPS).astype(np.uint64) << np.uint64(3)
    k = k - ((upto << np.uint64(8)) >> octet & np.uint64(255))
    return octet.astype(np.int64) + _PLACE[(words >> octet & np.uint64(255)).astype(np.int64), k.astype(np.int64)]


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file of a shared folder; the file appears whole or not at all, and a repeated task may write it anew."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    head, at = {}, 0
    for key, a in arrays.items():
        head[key] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    draft = f"{base}/.{name}-{np.random.default_rng().integers(1 << 62):x}"
    with store.open_output_stream(draft) as out:
        out.write(len(text).to_bytes(8, "little") + text + b" " * (-(8 + len(text)) % 64))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    store.move(draft, f"{base}/{name}")


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; a file of a remote store is first copied to a nameless local one."""
    store, base = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(f"{base}/{name}", np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{base}/{name}") as source:
            while block := source.read(1 << 24):
                copy.write(block)
            copy.flush()
            data = np.memmap(copy, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    start = 8 + size + (-(8 + size) % 64)
    flat = np.asarray(data)
    return {
        key: flat[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for key, (kind, at, n) in head.items()
    }


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each begins."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)
    return sorted_keys[first], first


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    distinct, first = runs(keys[order])
    return distinct, np.add.reduceat(counts[order], first) if len(first) else counts[:0]


