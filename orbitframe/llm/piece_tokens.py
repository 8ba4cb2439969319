"""SentencePiece encoding and decoding (operator 2).

Method: the last token of a prefix's encoding is unique, so one left-to-right pass stores it for every prefix.
An Aho-Corasick automaton names the vocabulary entries that end at a place; an entry is the prefix's last token
if it starts the text, or if it can stand beside the last token of the prefix before it, which is tested by
undoing merges from the pair's border outwards.  The ids are then read backwards.

Merges never reach over a word border (no entry has the word mark after another character) nor over a
character without an entry, so texts are cut there and each distinct piece is encoded once per worker while a
bounded table holds it.  Runs of two or more word marks have entries with tied scores, for which a prefix's
last token is not unique; those pieces are encoded by merging.

Nulls count as empty texts; an empty text has the end id only.  Rows are handled one by one: repeated rows,
null keys and extra columns have no influence, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
#: Entries a worker keeps of distinct words and of tested pairs; past that a table is emptied.
WORDS_KEPT = 400_000
PAIRS_KEPT = 1_000_000
_built: dict[str, "PieceCodec"] = {}


def load_vocabulary(path: str) -> dict:
    """Pieces, scores and kinds of a merge-type model with an identity normalizer."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    probe = " a  ﬁ é\n "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("only models that leave texts as they are can be used")
    pieces = [model.id_to_piece(i) for i in range(n)]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece reaches over a word border")
    plain = [not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    digest = hashlib.sha256(repr((pieces, [model.get_score(i) for i in range(n)], plain)).encode()).hexdigest()
    return {"digest": digest, "pieces": pieces, "scores": [model.get_score(i) for i in range(n)], "plain": plain, "bytes": [i for i in range(n) if model.is_byte(i)], "end": model.eos_id()}


class PieceCodec:
    def __init__(self, vocabulary: dict):
        import ahocorasick

        pieces, scores, plain = vocabulary["pieces"], vocabulary["scores"], vocabulary["plain"]
        self.pieces, self.end = pieces, vocabulary["end"]
        self.byte_id = {int(pieces[i][1:-1], 16): i for i in vocabulary["bytes"]}
        self.id_byte = {v: k for k, v in self.byte_id.items()}
        self.score = {pieces[i]: scores[i] for i in range(len(pieces)) if plain[i]}
        self.ids = {pieces[i]: i for i in range(len(pieces)) if plain[i]}
        single = sorted(p for p in self.ids if len(p) == 1)
        longer = sorted((p for p in self.ids if len(p) > 1 and p.strip(MARK)), key=lambda p: -self.score[p])
        if len({self.score[p] for p in longer}) != len(longer):
            raise ValueError("scores of pieces must differ")
        self.alphabet = frozenset(single)
        self.name = single + longer  # in order of merging
        self.rank = {p: r for r, p in enumerate(self.name)}
        self.out = [self.ids[p] for p in self.name]
        self.parts: list[tuple[int, int]] = [(r, r) for r in range(len(self.name))]
        self.automaton = ahocorasick.Automaton()
        for r, p in enumerate(self.name):
            if r >= len(single):
                left, right = self._last_merge(p)
                if left is None:
                    continue  # no text is ever encoded to it
                self.parts[r] = (self.rank[left], self.rank[right])
            self.automaton.add_word(p, (r, len(p)))
        self.automaton.make_automaton()
        self.unknown = re.compile("([^" + re.escape("".join(single)) + "])")
        self.pair: dict[int, bool] = {}
        self.after_mark: dict[str, tuple[str, str]] = {}
        self.bare: dict[str, tuple[str, str]] = {}

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Merging by score, leftmost first among equals; also the last pair merged."""
        score, n, last = self.score, len(symbols), None
        text: list[str | None] = list(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = text[i] + text[j]
            if both in score:
                heapq.heappush(heap, (-score[both], i, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if text[i] is None or j >= n or text[i] + text[j] != both:
                continue
            last = (text[i], text[j])
            text[i], text[j], right[i] = both, None, right[j]
            if right[i] < n:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [t for t in text if t is not None], last

    def _last_merge(self, piece: str) -> tuple[str | None, str | None]:
        if any(c not in self.ids for c in piece):
            return None, None
        out, last = self.merged(list(piece))
        return last if len(out) == 1 else (None, None)

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the two tokens' joined text gives just these two tokens."""
        rank, name, parts, limit = self.rank, self.name, self.parts, len(self.name)
        while True:
            both = rank.get(name[a] + name[b])
            if both is not None and both < limit:
                return False
            if a > b:
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def known(self, text: str) -> list[int]:
        """Ids of a text whose characters all have entries and that has no run of word marks."""
        last = [-1] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        pair = self.pair
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                key = before << 20 | token
                fits = pair.get(key)
                if fits is None:
                    if len(pair) >= PAIRS_KEPT:
                        pair.clear()
                    fits = pair[key] = self.compatible(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        at, ids = len(text), []
        while at:
            ids.append(self.out[last[at]])
            at -= size[at]
        return ids[::-1]

    def piece_ids(self, text: str) -> list[int]:
        if text.startswith(MARK + MARK):
            run = len(text) - len(text.lstrip(MARK))
            symbols: list[str] = []
            for k, part in enumerate(self.unknown.split(text)):
                symbols += [part] if k % 2 else list(part)
            out: list[int] = []
            for t in self.merged(symbols)[0] if run < len(text) else self.merged([MARK] * run)[0]:
                out += [self.ids[t]] if t in self.ids else [self.byte_id[b] for b in t.encode()]
            return out
        ids: list[int] = []
        for k, part in enumerate(self.unknown.split(text)):
            if k % 2:
                ids += [self.byte_id[b] for b in part.encode()]
            elif part:
                ids += self.known(part)
        return ids

    def text_of(self, ids: list[int]) -> str:
        """Decoded text, with the leading mark still on it."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.id_byte:
                raw.append(self.id_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i != self.end:
                out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids with the end id."""
        if not text:
            return [self.end]
        ids: list[int] = []
        for piece in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)):
            ids += self.piece_ids(piece)
        return [*ids, self.end]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the mark put before every text goes."""
        text = self.text_of(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(MARK) else text

    def _line_end(self, word: str) -> tuple[str, str]:
        """A word with line ends in it: only its parts are kept."""
        head, *rest = word.split("\n")
        got = [self.after_mark.get(head) or self._add(self.after_mark, head, MARK + head)]
        for part in rest:
            got.append((str(self.byte_id[10]), "\n"))
            if part:
                got.append(self.bare.get(part) or self._add(self.bare, part, part))
        return " ".join(g[0] for g in got), "".join(g[1] for g in got)

    def _add(self, table: dict, key: str, text: str) -> tuple[str, str]:
        if "\n" in key:
            return self._line_end(key)
        ids = self.piece_ids(text)
        got = (" ".join(map(str, ids)), self.text_of(ids))
        if len(key) <= 64:
            if len(table) >= WORDS_KEPT:
                table.clear()
            table[key] = got
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """Ids joined by spaces, their number, and the decoded text."""
        if not text:
            return 1, str(self.end), ""
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK not in marked:
            table = self.after_mark
            got = [table.get(w) or self._add(table, w, MARK + w) for w in marked[1:].split(MARK)]
            ids = " ".join([g[0] for g in got])
            back = "".join([g[1] for g in got])
        else:
            got = [self.piece_ids(p) for p in re.findall(f"{MARK}+[^{MARK}]*", marked)]
            flat = [i for g in got for i in g]
            ids, back = " ".join(map(str, flat)), self.text_of(flat)
        ids = f"{ids} {self.end}"
        return ids.count(" ") + 1, ids, back[1:] if back.startswith(" ") else back


def codec_of(vocabulary: dict) -> PieceCodec:
    """The codec of a vocabulary, built once per worker."""
    key = vocabulary["digest"]
    if key not in _built:
        _built.clear()
        _built[key] = PieceCodec(vocabulary)
    return _built[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>, with the end id) and decoded text of every row."""
    return _mapped(docs, model_path, id_col, text_col, f"`{id_col}` {_kind(docs, id_col)}, ids array<int>, decoded string", False)


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and sha-256 digests of the ids and of the decoded text of every row."""
    return _mapped(docs, model_path, id_col, text_col, f"`{id_col}` {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string", True)


def _kind(docs: DataFrame, name: str) -> str:
    return docs.schema[name].dataType.simpleString()


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, digest: bool) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))  # its size is the model's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, ids, back = [], [], []
                for scalar in part.column(1):
                    text = scalar.as_py() or ""
                    if digest:
                        count, joined, decoded = codec.digest(text)
                        n.append(count)
                        ids.append(hashlib.sha256(joined.encode()).hexdigest())
                        back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        got = codec.encode(text)
                        ids.append(got)
                        back.append(codec.decode(got))
                arrays = [part.column(0), *([pa.array(n, pa.int64()), pa.array(ids, pa.string())] if digest else [pa.array(ids, pa.list_(pa.int32()))]), pa.array(back, pa.string())]
                names = [id_col, *(["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
