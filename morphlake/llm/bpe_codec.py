"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For a BPE vocabulary the encoding of every prefix of a word ends in one unique token. An automaton
of the vocabulary gives, at each position, all tokens that are suffixes of the prefix; the one that
may follow the last token of the prefix before it is that last token. Following the back-pointers
from the end of the word gives the ids. Two tokens may stand side by side if merging their joined
text would not cross their border before it has built both; that test walks down their merge trees.

The codec covers files of the lower-casing word kind: NFC, white space as one blank, lower case,
cut by a pattern that keeps no white space, bytes as characters, an end-of-word suffix. Text with
characters that Unicode 3.2 does not know is normalised and cut by the library's own tables, since
versions differ on them; its words are encoded like all others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches
from .token_counts import byte_alphabet

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries a worker keeps of encoded words; a full cache is emptied, which costs time but no result.
CACHE_ENTRIES = 600_000
#: Stands for the end of a word inside the automaton; no byte has this code.
END = "Ā"
_CODECS: dict[str, WordBpe] = {}


class WordBpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        suffix = model["end_of_word_suffix"]
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True)
            or (level["type"], level["add_prefix_space"], level["use_regex"]) != ("ByteLevel", False, False)
            or not suffix
            or spec["decoder"] is not None
        ):
            raise ValueError("not a tokenizer file of the lower-casing word kind")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.special_bytes = [x.encode() for x in added]
        self.alphabet = alphabet = byte_alphabet()

        def plain(token: str) -> str:
            """Token as a string of one character a byte, END after its last if it ends a word."""
            ends = token.endswith(suffix)
            return "".join(chr(alphabet[c]) for c in (token[: -len(suffix)] if ends else token)) + END * ends

        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        self.piece = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.rank = {i: -1 for i in vocab.values()}  # of tokens that no merge makes
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            token = vocab[left + right]
            self.merge[vocab[left], vocab[right]] = token
            if token not in self.parts:
                self.parts[token], self.rank[token] = (vocab[left], vocab[right]), rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.matches = ahocorasick.Automaton()
        for text, i in vocab.items():
            key = plain(text)
            if key and (i in self.parts or len(key.rstrip(END)) == 1):
                self.matches.add_word(key, (len(key), i))
        self.matches.make_automaton()
        self.ids: dict[bytes, bytes] = {}
        self.texts: dict[bytes, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` directly after ``left`` is what merging their joined text leaves."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 4 * CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo merges from the last to the first; at every moment the two tokens at the border are
        # (left, right). The border breaks if a merge of these two comes before the merge, on
        # either side, that replaces one of them. On equal rank the leftmost merge comes first.
        rank, parts = self.rank, self.parts
        due = (len(self.merge), 0)  # when the younger of the two at the border is merged into what was undone
        while True:
            across = self.merge.get((left, right))
            if across is not None and (rank[across], 1) < due:
                return False
            if left not in parts and right not in parts:
                return True
            if rank[left] > rank[right]:
                due, left = (rank[left], 0), parts[left][1]
            else:
                due, right = (rank[right], 2), parts[right][0]

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as a character a byte, without END."""
        n = len(symbols)
        last = [-1] * (n + 2)  # last token of the prefix's encoding, and where that token starts
        start = [0] * (n + 2)
        for end, (length, token) in self.matches.iter(symbols + END):
            end += 1
            if last[end] >= 0 or end == n:
                continue
            begin = end - length
            if begin == 0 or (last[begin] >= 0 and self.may_follow(last[begin], token)):
                last[end], start[end] = token, begin
        at, ids = n + 1, []
        while at:
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def _miss(self, chunk: bytes) -> None:
        if len(self.ids) >= CACHE_ENTRIES:
            self.ids.clear()
            self.texts.clear()
        text = chunk.decode()
        if not text.isascii() and any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in text):
            # Letters and digits are told apart by tables of other Unicode versions than the library's.
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            parts = ["".join(chr(self.alphabet[c]) for c in part) for part, _ in cut]
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each capital alone
            parts = [part.encode().decode("latin-1") for part in self.pattern.findall(text)]
        ids = [i for part in parts for i in self.word(part)]
        self.ids[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        self.texts[chunk] = "".join(" " + self.piece[i] for i in ids).encode()

    def _plain(self, data: bytes) -> tuple[bytes, bytes]:
        # No token spans white space, so ASCII white space may cut the text before all else.
        chunks = data.split()
        out_ids, out_text = [], []
        for i in range(0, len(chunks), 100_000):
            part = chunks[i : i + 100_000]
            for chunk in {*part}:
                if chunk not in self.ids:
                    self._miss(chunk)
            try:
                out_ids.append(b"".join(map(self.ids.__getitem__, part)))
                out_text.append(b"".join(map(self.texts.__getitem__, part)))
            except KeyError:  # the cache was emptied on the way
                for chunk in part:
                    if chunk not in self.ids:
                        self._miss(chunk)
                    out_ids.append(self.ids[chunk])
                    out_text.append(self.texts[chunk])
        return b"".join(out_ids), b"".join(out_text)

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded text as UTF-8."""
        data = (text or "").encode()
        if not any(x in data for x in self.special_bytes):
            ids, decoded = self._plain(data)
            return ids, decoded[1:]
        both = []
        for part in self.specials.split(text):
            if part in self.added:
                both.append((struct.pack("<I", self.added[part]), (" " + part).encode()))
            else:
                both.append(self._plain(part.encode()))
        return b"".join(x for x, _ in both), b"".join(x for _, x in both)[1:]

    def decode(self, ids: bytes) -> str:
        """Text of ids, with special tokens; a file without decoder joins tokens by blanks."""
        return " ".join(self.piece[i] for (i,) in struct.iter_unpack("<I", ids))


def codec(path: str) -> WordBpe:
    if path not in _CODECS:
        _CODECS[path] = WordBpe(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, for every row of ``docs`` (doc_id, text).

    Null texts count as empty: no ids, digests of nothing. Repeated rows are each returned, an empty
    table gives no rows, other columns are ignored. Works row by row without a shuffle; a worker
    keeps encodings of at most CACHE_ENTRIES words.
    """

    def run(batches):
        own = codec(tokenizer_path)
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for text in batch.column(1):
                ids, decoded = own.encode(text.as_py())
                n.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(decoded).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = bounded_batches(docs).select("doc_id", docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA.replace("doc_id long", f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"))
