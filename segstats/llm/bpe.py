"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding with a byte-to-text state machine.

Merging is local: what comes after a prefix of a piece can change the tokens of
the prefix near its end only.  :func:`sufficient_lookahead` computes from the
merge list how far that reaches.  Seen as a run over the merges in rank order,
the tokens of a prefix p and of a longer text agree up to a boundary that starts
at the end of p.  A rule (u, v) moves the boundary back by u when u stands just
before it.  If (u, v) did so and a later rule (x, y) does so next, y begins with
u: u lies on the left edge of the merge tree of y.  The longest chain of rules in
rank order, each counted with the length of its left part, is therefore enough.

The transducer keeps a window of the open piece.  Whenever the window is a block
longer than the lookahead it is merged, the tokens that end before the last
``lookahead`` bytes are stable and are emitted, and the rest stays in the window.
A boundary of the final tokens is crossed by no merge, so going on from there
gives the same tokens.  Text is read in slices; memory does not depend on the
length of the text, of a word or of a run of marks.  The windows of short pieces
end with their piece; those of a slice are merged together, a row of a matrix
each.  Pieces that come again are looked up in a bounded memory of the worker.

Special tokens of the file that stand in a text are single ids, as in the
library.  Files without byte-level pre-tokenizer, with a normalizer, or whose
merges are not in an order in which every part is made before it is used, are
refused.

Defined results: null text is empty and has no ids; an empty table gives no rows;
rows that repeat are rows of their own; extra columns are left out.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers



def _unknown_to_library() -> str:
    """Ranges of characters that are letters or numbers in this module's Unicode version and neither in the tokenizer library's."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    young = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and len(split("!" + c)) == 1]
    ranges: list[list[int]] = []
    for c in map(ord, young):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_NOT = f"--[{_young}]" if (_young := _unknown_to_library()) else ""
_LETTER, _NUMBER = rf"[\p{{L}}{_NOT}]", rf"[\p{{N}}{_NOT}]"
_OTHER = rf"[^\s{_LETTER}{_NUMBER}]"
#: The pattern of byte-level pre-tokenizers (fixed values of the format).
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?{_OTHER}+|\s+(?!\S)|\s+", regex.V1)
_RUNS = [regex.compile(p, regex.V1) for p in (rf"{_LETTER}+", rf"{_NUMBER}+", r"\s+", rf"{_OTHER}+")]
#: Characters of a text, and of several short ones, that are looked at at once; bytes that are merged at once besides the lookahead; length from which a piece is open.
SLICE, TOGETHER, BLOCK, OPEN = 1 << 16, 1 << 20, 1 << 10, 1 << 12
#: Pieces of a generation that a worker remembers, and the longest that is; bytes of a window that shares a matrix with others, and how many share one at least.
REMEMBERED, LONGEST, SHORT, FEW = 250_000, 48, 64, 32


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes (letters of the merge list) after which a token can no longer change.

    Raises ValueError when a part is used before it is made or made twice; the
    argument needs merges in such an order.
    """
    made: dict[str, int] = {}
    reach: dict[str, int] = {}
    longest = 0
    for rank, (u, v) in enumerate(merges):
        if u + v in made or any(len(x) > 1 and x not in made for x in (u, v)):
            raise ValueError(f"merge {rank} is out of order")
        edge, back = v, reach.get(v, 0)
        while edge in made:
            edge = merges[made[edge]][0]
            back = max(back, reach.get(edge, 0))
        reach[u] = max(reach.get(u, 0), len(u) + back)
        longest = max(longest, len(u) + back)
        made[u + v] = rank
    return longest


def byte_letters() -> list[str]:
    """The letter by which byte-level files write each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class _Ranks(dict):
    """(left, right) -> number of the merged token; pairs that never merge are larger than any."""

    def __missing__(self, pair: tuple[int, int]) -> int:
        return 1 << 40


_NEVER = np.int32(1 << 30)


class Rules:
    """A byte-level BPE file: merges over numbers 0-255 (bytes) and 256 + rank, and the ids behind them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind, model = file["pre_tokenizer"] or {}, file["model"]
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind["add_prefix_space"] and file["normalizer"] is None
        if model.get("type") != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout") or (file["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges)
        letters = byte_letters()
        number = {c: b for b, c in enumerate(letters)} | {u + v: 256 + k for k, (u, v) in enumerate(merges)}
        self.ranks = _Ranks({(number[u], number[v]): 256 + k for k, (u, v) in enumerate(merges)})
        spelled = {n: s for s, n in number.items()}
        byte_of = {c: b for b, c in enumerate(letters)}
        self.ids = [model["vocab"][spelled[n]] for n in range(len(spelled))]
        self.bytes_of_id = {i: bytes(map(byte_of.__getitem__, s)) if all(c in byte_of for c in s) else s.encode() for s, i in model["vocab"].items()}
        self.sizes = [1] * 256 + [len(u) + len(v) for u, v in merges]
        self.special: dict[str, int] = {}
        for t in file["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"{path}: added tokens that take more than themselves")
            self.special[t["content"]] = t["id"]
            self.bytes_of_id[t["id"]] = bytes(map(byte_of.__getitem__, t["content"])) if all(c in byte_of for c in t["content"]) else t["content"].encode()

        self.pair_keys = np.array(sorted(a * len(spelled) + b for a, b in self.ranks), np.int64)
        self.pair_new = np.array([self.ranks[divmod(int(k), len(spelled))] for k in self.pair_keys], np.int32)
        self.id_table = np.array(self.ids, np.uint32)

    def _new(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges to; _NEVER for pairs that do not merge."""
        keys = left.astype(np.int64) * len(self.ids) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_new[at], _NEVER)

    def merged_windows(self, windows: list[bytes]) -> list[bytes]:
        """Ids of short windows that end with their piece, as bytes: one matrix row each, the best pair of every row merged at a time."""
        width = max(map(len, windows))
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        tokens = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in windows), np.uint8).reshape(len(windows), width + 1).astype(np.int32)
        columns = np.arange(width)
        pairs = np.where(columns < sizes[:, None] - 1, self._new(tokens[:, :-1], tokens[:, 1:]), _NEVER)
        rows = np.arange(len(windows))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            k = pairs.argmin(axis=1)
            every = np.arange(len(rows))
            new = pairs[every, k]
            going = new < _NEVER
            if not going.all():
                done.append((rows[~going], tokens[~going, :-1]))
                rows, tokens, pairs, k, new = rows[going], tokens[going], pairs[going], k[going], new[going]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            size = sizes[rows] - 1
            sizes[rows] = size
            after = np.arange(width + 1) + (np.arange(width + 1) > k[:, None])  # the right part of the pair goes
            tokens = np.take_along_axis(tokens, np.minimum(after, width), axis=1)
            pairs = np.take_along_axis(pairs, np.minimum(after[:, :-1], width - 1), axis=1)
            tokens[every, k] = new
            pairs[:, -1] = _NEVER
            pairs[every, k] = np.where(k < size - 1, self._new(new, tokens[every, k + 1]), _NEVER)
            left = np.maximum(k - 1, 0)
            pairs[every, left] = np.where(k > 0, self._new(tokens[every, left], new), pairs[every, left])
        out: list[bytes] = [b""] * len(windows)
        for which, found in done:
            ids = self.id_table[found]
            for row, n, line in zip(which.tolist(), sizes[which].tolist(), ids):
                out[row] = line[:n].tobytes()
        return out

    def merged(self, tokens: list[int]) -> list[int]:
        """Merge until nothing merges: the lowest rank first, from left to right."""
        ranks = self.ranks
        while len(tokens) > 1:
            pairs = list(map(ranks.__getitem__, zip(tokens, tokens[1:])))
            new = min(pairs)
            if new >= 1 << 40:
                break
            out, i, last = [], 0, len(tokens) - 1
            while True:
                try:
                    k = pairs.index(new, i)
                except ValueError:
                    out += tokens[i:]
                    break
                out += tokens[i:k]
                out.append(new)
                i = k + 2
                if i > last:
                    break
            tokens = out
        return tokens


class Transducer:
    """Tokens of one piece after another; holds at most lookahead + BLOCK bytes and one fed part of the open piece."""

    def __init__(self, rules: Rules, out: array, block: int = BLOCK):
        self.rules, self.out, self.block, self.window = rules, out, block, b""

    def feed(self, data: bytes) -> None:
        for at in range(0, len(data), self.block):
            self.window += data[at : at + self.block]
            if len(self.window) > self.rules.lookahead + self.block:
                self._emit(len(self.window) - self.rules.lookahead)

    def end(self) -> None:
        """The piece ends: all of its tokens are stable."""
        if self.window:
            self._emit(len(self.window))

    def _emit(self, stable: int) -> None:
        rules, done = self.rules, 0
        for t in rules.merged(list(self.window)):
            if done + rules.sizes[t] > stable:
                break
            self.out.append(rules.ids[t])
            done += rules.sizes[t]
        self.window = self.window[done:]


class Encoder:
    """Ids of texts by a byte-level BPE file, as the tokenizers library gives them without special tokens added."""

    def __init__(self, path: str, slice_: int = SLICE, block: int = BLOCK, open_: int = OPEN):
        self.rules = Rules(path)
        self.slice, self.block, self.open = slice_, block, open_
        self.known = _Memory()
        self.pieces = _Memory()
        special = sorted(self.rules.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.held = max(map(len, special), default=1) - 1

    def ids(self, text: str) -> array:
        """All ids of a text, in slices."""
        out = array("I")
        for part in self.stream(text[i : i + self.slice] for i in range(0, len(text), self.slice)):
            out.frombytes(part)
        return out

    def stream(self, slices: Iterable[str]) -> Iterator[bytes]:
        """Ids as little-endian bytes, as soon as they are stable, of a text that comes in slices."""
        segment, rest = _Segment(self), ""
        for part in slices:
            rest += part
            if self.special is not None:
                for found in iter(lambda: self.special.search(rest), None):
                    yield segment.feed(rest[: found.start()]) + segment.end()
                    yield array("I", [self.rules.special[found[0]]]).tobytes()
                    segment, rest = _Segment(self), rest[found.end() :]
            keep = self._begun(rest)
            yield segment.feed(rest[: len(rest) - keep])
            rest = rest[len(rest) - keep :]
        yield segment.feed(rest) + segment.end()

    def _begun(self, text: str) -> int:
        """Characters at the end that may be the beginning of a special token."""
        for n in range(min(self.held, len(text)), 0, -1):
            if any(s.startswith(text[-n:]) for s in self.rules.special):
                return n
        return 0

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as bytes; short ones are looked at together."""
        out: list[bytes] = [b""] * len(texts)
        some: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if len(text) > self.slice or self.special is not None and self.special.search(text):
                out[k] = self.ids(text).tobytes()
                continue
            some.append(k)
            size += len(text)
            if size > TOGETHER:
                self._fill(out, some, texts)
                some, size = [], 0
        self._fill(out, some, texts)
        return out

    def _fill(self, out: list[bytes], some: list[int], texts: list[str]) -> None:
        for k, ids in zip(some, self.joined([texts[k] for k in some])):
            out[k] = ids

    def joined(self, texts: list[str]) -> list[bytes]:
        """Ids of stretches of whole pieces."""
        cut = [_stretches(t) for t in texts]
        self.known.learn({w for _, words in cut for w in words}, self._stretch_ids)
        heads = {head for head, _ in cut if head}
        found = dict(zip(heads, self._piece_ids([PIECE.findall(head) for head in heads]))) | {"": b""}
        get = self.known.young.__getitem__
        return [found[head] + b"".join(map(get, words)) for head, words in cut]

    def _stretch_ids(self, words: list[str]) -> list[bytes]:
        parts = []
        for w in words:
            if w.isalpha():
                parts.append((" " + w,))
            elif w[-1:] in _ENDS and w[:-1].isalpha():
                parts.append((" " + w[:-1], w[-1]))
            else:
                parts.append(PIECE.findall(w if w[:1] == "\n" else " " + w))
        return self._piece_ids(parts)

    def _piece_ids(self, parts: list) -> list[bytes]:
        """Ids of lists of pieces."""
        self.pieces.learn({p for ps in parts for p in ps}, self._merged)
        get = self.pieces.young.__getitem__
        return [get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps)) for ps in parts]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        windows = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(windows)
        for least, most in ((0, 12), (12, 24), (24, SHORT)):
            some = [k for k, w in enumerate(windows) if least < len(w) <= most]
            if len(some) < FEW:
                for k in some:
                    out[k] = array("I", [self.rules.ids[t] for t in self.rules.merged(list(windows[k]))]).tobytes()
                continue
            for at in range(0, len(some), 1 << 14):
                part = some[at : at + (1 << 14)]
                for k, ids in zip(part, self.rules.merged_windows([windows[k] for k in part])):
                    out[k] = ids
        for k, w in enumerate(windows):
            if len(w) > SHORT:
                ids = array("I")
                piece = Transducer(self.rules, ids, self.block)
                piece.feed(w)
                piece.end()
                out[k] = ids.tobytes()
        return out


#: White space that is neither a single space nor a single line end, or touches another: such texts are cut with care.
_ODD = re.compile("[\t\r\v\f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]")
#: Marks that end a stretch of letters as a piece of their own.
_ENDS = frozenset(".,;:!?")
#: Before a space that stands between two characters that are not white space: the pre-tokenizer always begins a piece there.
_SPACE = regex.compile(r"(?<=\S)(?= \S)", regex.V1)
_WHITE, _AFTER = regex.compile(r"\s"), regex.compile(r" \S")


def _stretches(text: str) -> tuple[str, list[str]]:
    """What stands before the first cut, and the stretches after it, each without the space it begins with unless it begins with a line end."""
    if _ODD.search(text):
        head, *rest = _SPACE.split(text)
        return head, [w[1:] for w in rest]
    head, *rest = text.replace("\n", " \n").split(" ")
    if rest and not rest[-1]:  # a space at the end is a piece
        return text, []
    return head, rest


class _Memory:
    """Ids of strings in two generations: what the younger lacks is looked up in the older before it is found anew."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, wanted: set[str], find) -> None:
        """Make the younger generation hold ``wanted``."""
        if len(self.young) > REMEMBERED:
            self.older = {k: v for k, v in self.young.items() if len(k) <= LONGEST}
            self.young = {}
        young, older = self.young, self.older
        new = [w for w in wanted if w not in young]
        if older:
            young.update((w, older[w]) for w in new if w in older)
            new = [w for w in new if w not in older]
        if new:
            young.update(zip(new, find(new)))


class _Segment:
    """The pre-tokenizer as a state machine over the slices of a text between special tokens.

    States: between pieces, with a carry that may still grow, or inside an open
    piece of one class of characters, longer than ``open``, that goes to the transducer part by part.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.carry = encoder, ""
        self.run: regex.Pattern | None = None
        self.out = array("I")
        self.piece = Transducer(encoder.rules, self.out, encoder.block)

    def feed(self, text: str) -> bytes:
        return self._take(self.carry + text, False) if text else b""

    def end(self) -> bytes:
        return self._take(self.carry, True)

    def _take(self, text: str, last: bool) -> bytes:
        self.carry = ""
        done = b""
        if self.run is not None:
            text = self._go_on(text, last)
            done = self._out()
        if text and not last:
            cut = self._open_end(text)
            text, self.carry = text[:cut], text[cut:]
        done += self._whole(text)
        if len(self.carry) > self.encoder.open:
            self._begin()
        return done + self._out()

    def _out(self) -> bytes:
        done = self.out.tobytes()
        del self.out[:]
        return done

    def _whole(self, text: str) -> bytes:
        return self.encoder.joined([text])[0] if text else b""

    def _open_end(self, text: str) -> int:
        """Where the last piece begins, which later text may change, with the white space before it, whose pieces depend on it."""
        at = text.rfind(" ")
        while at > 0 and (_WHITE.match(text[at - 1]) or not _AFTER.match(text, at)):
            at = text.rfind(" ", 0, at)
        starts = [max(at, 0)]
        starts += (found.start() for found in PIECE.finditer(text, starts[0]))
        start = starts.pop()
        while starts and (_WHITE.match(text[start - 1]) or text[starts[-1] : start] == "'"):  # "'": a contraction may be under way
            start = starts.pop()
        return start

    def _begin(self) -> None:
        """The carry is long: its whole pieces go, and the last one is open if it is long itself (a contraction never is)."""
        *whole, last = PIECE.findall(self.carry)
        if len(last) < 4 and whole and whole[-1] == "'":
            last = whole.pop() + last
        for part in whole:
            self.piece.feed(part.encode())
            self.piece.end()
        self.carry = last
        if len(last) > 4:
            self.run = next(r for r in _RUNS if r.match(last[-1]))
            held = last[-1] if self.run is _RUNS[2] else ""  # the last white space may belong to the next piece
            self.piece.feed(last[: len(last) - len(held)].encode())
            self.carry = held

    def _go_on(self, text: str, last: bool) -> str:
        """Feed what continues the open piece; returns the text after it, if it ends."""
        found = self.run.match(text)
        size = len(found[0]) if found else 0
        if self.run is _RUNS[2] and not (last and size == len(text)):
            size = max(0, size - 1)
            open_still = size + 1 >= len(text)
        else:
            open_still = size == len(text)
        self.piece.feed(text[:size].encode())
        if open_still and not last:
            self.carry = text[size:]
            return ""
        self.piece.end()
        self.run = None
        return text[size:]


class Decoder:
    """Bytes of ids to text as they come: UTF-8 as a state machine that holds an unfinished character; what is no UTF-8 becomes U+FFFD."""

    def __init__(self, rules: Rules):
        self.bytes_of_id = rules.bytes_of_id
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of_id.__getitem__, ids)))

    def end(self) -> str:
        return self.machine.decode(b"", True)


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, once for each worker process."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = encoder(path).many
        for batch in batches:
            lists = pa.array([np.frombuffer(b, np.int32) for b in many([t.as_py() or "" for t in batch.column(1)])], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), lists], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = encoder(path).rules
        for batch in batches:
            texts = []
            for row in batch.column(1):
                decoder = Decoder(rules)
                texts.append(decoder.feed(row.as_py() or []) + decoder.end())
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, from the ids and the text decoded from them."""

    def digests(found: bytes, rules: Rules, names: list[str]) -> tuple[int, str, str]:
        ids, ids_hash, text_hash, decoder = memoryview(found).cast("I"), hashlib.sha256(), hashlib.sha256(), Decoder(rules)
        for at in range(0, len(ids), SLICE):
            part = ids[at : at + SLICE].tolist()
            ids_hash.update(("," if at else "").encode() + ",".join(map(names.__getitem__, part)).encode())
            text_hash.update(decoder.feed(part).encode())
        text_hash.update(decoder.end().encode())
        return len(ids), ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        names = [str(i) for i in range(max(known.rules.bytes_of_id) + 1)]
        for batch in batches:
            rows = [digests(b, known.rules, names) for b in known.many([t.as_py() or "" for t in batch.column(1)])]
            n, ids, texts = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
