"""Token ids of whole texts with the ``tokenizers`` library, with remembered segments."""

from __future__ import annotations

import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release_memory

#: White space other than the plain space and the line feed, as any Unicode version has it.
ODD_SPACE = (*"\t\v\f\r\x1c\x1d\x1e\x1f", *map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))


#: Words of these letters alone are one word to any pre-tokenizer, and no normal form or lower-casing changes them.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

#: Letters, and ASCII marks without the apostrophe, which may begin an ending.
LETTER, MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
#: Strings that the byte-level pre-tokenizer leaves whole.
ONE = re.compile(rf" ?(?:[{LETTER}]+|[0-9]+|[{MARK}]+)|\n")
#: Places where it cuts whatever stands around them: before a mark after a letter or digit, on both sides of a single line feed.
CUTS = [(f"([{LETTER}0-9])([{MARK}])", "\\1 \0\\2"), (f"([{LETTER}0-9{MARK}])\n([{LETTER}])", "\\1 \0\n \0\\2")]
#: The characters that stand for bytes in a byte-level vocabulary; byte 0 parts strings here.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED) if b}


class SegmentEncoder:
    """Encodes batches of texts to ids.

    The vocabularies' pre-tokenizers never join a character with a space that follows it,
    so a text whose white space is single spaces and line feeds is cut before each space.
    The distinct pieces of a batch are found by Arrow, encoded by the library (or remembered from earlier
    batches, in a table of bounded size), and their ids are put in the places of the pieces. Any
    other text is given to the library whole. Ids are equal to those of the whole text in both cases.

    Where the pre-tokenizer is the byte-level one, texts are also cut before marks and around line feeds, so that more
    pieces are equal, and pieces that it would leave whole go to the vocabulary's model directly."""

    def __init__(self, path: str, capacity: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.capacity = capacity
        added = self.tok.get_added_tokens_decoder()
        self.mark_id, self.mark = next(((i, t.content) for i, t in added.items() if t.special), (-1, ""))
        self.known: dict[str, bytes] = {}
        self.added = [t.content for t in added.values()]
        model, how = self.tok.model, self.tok.pre_tokenizer
        #: Whether texts are cut by the byte-level pre-tokenizer and its pieces encoded by merges alone.
        self.direct = (
            type(how).__name__ == "ByteLevel" and how.use_regex and not how.add_prefix_space and self.tok.normalizer is None
            and type(model).__name__ == "BPE" and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
            and not any(t == " " or ONE.fullmatch(t) for t in self.added)
        )

        def same(a, b):
            return self.tok.encode(a, add_special_tokens=False).ids == self.tok.encode(b, add_special_tokens=False).ids

        #: Whether white space only parts words and case is ignored: then more pieces are equal.
        self.loose = same("Ab c", "ab \n c") and same(" a ", "a") and same("A, b", "a , b")
        suffix = getattr(self.tok.model, "end_of_word_suffix", None) if self.loose else None
        #: Ids that end a word, where the vocabulary marks them.
        self.last = np.zeros(self.tok.get_vocab_size() if suffix else 0, bool)
        if suffix:
            self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True

    def _words(self, words: list[str]) -> dict[int, bytes]:
        """Ids of those that are plain words, many in one call: parted by spaces in it and by the ids that end a word after it."""
        plain = [i for i, w in enumerate(words) if LETTERS.fullmatch(w.strip(" "))] if len(self.last) else []
        done: dict[int, bytes] = {}
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join([words[j].strip(" ") for j in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for j, end in zip(part, ends.tolist()):
                    done[j] = raw[4 * at : 4 * end]
                    at = end
        return done

    def _merged(self, words: list[str]) -> dict[int, bytes]:
        """Ids of those that a byte-level pre-tokenizer leaves whole, by the library's merges alone."""
        one = [i for i, w in enumerate(words) if ONE.fullmatch(w)] if self.direct else []
        chars = "\0".join([words[i] for i in one]).encode().decode("latin-1").translate(BYTE_CHARS).split("\0")
        tokenize = self.tok.model.tokenize
        return {i: array("I", [x.id for x in tokenize(w)]).tobytes() for i, w in zip(one, chars)}

    def _library(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Many short texts go in one call, parted by a special token: the
        library splits there before anything else, so each is encoded as if alone."""
        done = self._merged(texts) or self._words(texts)
        mark = self.mark[:1]
        short = [i for i, t in enumerate(texts) if mark and i not in done and len(t) < 200 and mark not in t]
        for i in range(0, len(short), 1000):
            part = short[i : i + 1000]
            ids = self.tok.encode_batch_fast(
                [self.mark.join([texts[j] for j in part])], add_special_tokens=False
            )[0].ids
            ids = np.array(ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw, at = ids.tobytes(), 0
            for j, end in zip(part, ends, strict=True):
                done[j] = raw[4 * at : 4 * end]
                at = end + 1
        rest = [i for i in range(len(texts)) if i not in done] if len(done) < len(texts) else []
        for i in rest:
            e = self.tok.encode_batch_fast([texts[i]], add_special_tokens=False)[0]
            done[i] = array("I", e.ids).tobytes()
        return [done[i] for i in range(len(texts))]

    def _plain(self, t: str) -> bool:
        if self.loose:
            return bool(t) and "\0" not in t and not any(c in t for c in (ODD_SPACE if not t.isascii() else ODD_SPACE[:8]))
        return not (
            not t or "\0" in t or t[0].isspace() or t[-1].isspace() or "  " in t or " \n" in t or "\n " in t
            or any(c in t for c in (ODD_SPACE if not t.isascii() else ODD_SPACE[:8]))
            or self.direct and any(c in t for c in self.added)
        )

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends of plain texts. A piece that follows no space, as a text's first, is marked by \\0."""
        if len(self.known) > self.capacity:  # the first met are the most frequent; the latest third goes
            self.known = dict(islice(self.known.items(), self.capacity * 2 // 3))
        marked = pa.array(["\0" + t for t in texts], pa.large_string())
        if self.loose:
            marked = pc.ascii_lower(pc.replace_substring(marked, "\n", " "))
            marked = pc.replace_substring_regex(marked, r"([a-z0-9])([.,:;?!]) ", r"\1 \2 ")
        for place, parted in CUTS if self.direct else ():
            marked = pc.replace_substring_regex(marked, place, parted)
        cut = pc.split_pattern(marked, " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, words))
        lacking = [i for i, x in enumerate(ids) if x is None]
        new = self._library([w[1:] if w[:1] == "\0" else " " + w for w in (words[i] for i in lacking)])
        for i, x in zip(lacking, new):
            ids[i] = x
        self.known.update((words[i], x) for i, x in zip(lacking, new))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        use = coded.indices.to_numpy()
        n = size[use]
        ends = np.cumsum(n)
        out = flat[np.repeat(start[use] - ends + n, n) + np.arange(ends[-1])]
        at = cut.offsets.to_numpy()
        return out, np.r_[0, ends][at[1:] - at[0]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other (uint32), and where each text's ids end."""
        plain = [self._plain(t) for t in texts]
        fast = [t for t, p in zip(texts, plain) if p]
        ids, ends = self._pieces(fast) if fast else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(fast) == len(texts):
            return ids, ends
        whole = iter(self._library([t for t, p in zip(texts, plain) if not p]))
        parts, k = [], 0
        for p in plain:
            if p:
                parts.append(ids[ends[k - 1] if k else 0 : ends[k]])
                k += 1
            else:
                parts.append(np.frombuffer(next(whole), "<u4"))
        return np.concatenate(parts) if parts else ids, np.cumsum([len(x) for x in parts], dtype=np.int64)

    def rest(self) -> None:
        """At the end of a task: keeps the pieces met first and gives memory back, as the worker may serve other stages."""
        if len(self.known) > self.capacity // 3:
            self.known = dict(islice(self.known.items(), self.capacity // 3))
        release_memory()


def encode_batches(batches, path: str, column: str = "text", size: int = 10_000_000):
    """Joins Arrow batches up to about ``size`` bytes (at least one batch) and yields each with the ids of its
    texts and their ends."""
    enc = encoder(path)

    def out(held):
        t = pa.Table.from_batches(held).combine_chunks()
        return t, *enc.encode(t.column(column).to_pylist())

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.nbytes
        if n >= size:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)
    held = None
    enc.rest()


_encoders: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One encoder for each vocabulary and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)
