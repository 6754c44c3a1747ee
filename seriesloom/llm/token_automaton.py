"""BPE as a deterministic token automaton: merges compiled by successive gadgets, words encoded by its transitions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import whole
from seriesloom.llm.pretokens import Cache, byte_letters, library_tokenizer, special_splitter, word_pieces

NEVER = 1 << 60
WORD_CACHE = 300_000
PAIR_CACHE = 1_000_000


class TokenAutomaton:
    """States are last tokens; an arc s -t-> t exists where t may follow s in a BPE tokenization.

    It starts as one state that loops on every symbol. The gadget of merge k, (u, v) -> w, adds the arc label w, gives it
    a state that is a copy of v's as it stands at step k, lets w be entered wherever u could be, and removes arc v from
    u's state, as u v is now always w. A copied row is kept as a reference to the row it copies and the step of copying,
    so compiling costs one record a merge; whether an arc exists is read by following copies back (`removed_at`).
    The language is exactly the tokenizations that applying the merges in order yields, one for each word, hence walking
    the labels' letters from each reachable position finds one valid last token for each prefix of a word.
    """

    def __init__(self, config: str):
        model = json.loads(config)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.label = {i: t for t, i in self.vocab.items()}
        self.label.update({t["id"]: t["content"] for t in json.loads(config)["added_tokens"]})
        size = max(self.label) + 1
        self.left, self.right, self.step = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        for k, merge in enumerate(model["merges"]):
            self._gadget(k, *(merge if isinstance(merge, list) else merge.split(" ")))
        self._removed: dict[int, int] = {}
        self.letter = byte_letters()
        self._arcs()

    def _gadget(self, k: int, u: str, v: str) -> None:
        a, b, w = self.vocab[u], self.vocab[v], self.vocab[(u[: -len(self.suffix)] if self.suffix and u.endswith(self.suffix) else u) + v]
        self.pair[a << 20 | b] = k
        if self.step[w] < 0:
            self.left[w], self.right[w], self.step[w] = a, b, k

    def removed_at(self, s: int, t: int) -> int:
        """The step from which arc t is absent from s's state, or NEVER."""
        key = s << 20 | t
        if key in self._removed:
            return self._removed[key]
        chain = []
        while True:  # follow copies back to rows that are no copies
            here = s << 20 | t
            known = self._removed.get(here)
            if known is not None:
                break
            a, b = self.step[s], self.step[t]
            chain.append((here, a, b))
            if a < 0 and b < 0:
                known = None
                break
            if a > b:
                s = self.right[s]
            elif b > a:
                t = self.left[t]
            else:
                s, t = self.right[s], self.left[t]
        below = known
        for here, a, b in reversed(chain):
            born = max(a, b)
            absent = below is not None and (below < born or (b > a and below == born))
            below = born if absent else self.pair.get(here, NEVER)
            self._removed[here] = below
        if len(self._removed) > PAIR_CACHE:
            self._removed.clear()
        return below

    def _arcs(self) -> None:
        """Letters to labels as a transition table: node -> {symbol: node}, and the label that ends at a node."""
        self.next, self.ends = [{}], [-1]
        for text, token in self.vocab.items():
            node = 0
            for symbol in self.symbols(text):
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = self.next[node][symbol]
            self.ends[node] = token

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            bare = token[: -len(self.suffix)]
            return [*bare[:-1], bare[-1] + self.suffix] if bare else [token]
        return list(token)

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word: positions in order, each reached by the one arc that its state allows."""
        letters = [self.letter[b] for b in word.encode("utf-8", "surrogatepass")]
        if not letters:
            return []
        letters[-1] += self.suffix
        n, table, ends = len(letters), self.next, self.ends
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            state = last[start]
            if start and state < 0:
                continue
            node = 0
            for stop in range(start, n):
                node = table[node].get(letters[stop], -1)
                if node < 0:
                    break
                token = ends[node]
                if token >= 0 and last[stop + 1] < 0 and (not start or self.removed_at(state, token) == NEVER):
                    last[stop + 1], begin[stop + 1] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = begin[at]
        return out[::-1]


@lru_cache(maxsize=2)
def automaton(config: str) -> TokenAutomaton:
    return TokenAutomaton(config)


@lru_cache(maxsize=2)
def _word_cache(config: str) -> Cache:
    machine = automaton(config)

    def entry(word: str) -> tuple[list[int], str, str]:
        ids = machine.encode(word)
        return ids, " ".join(map(str, ids)), " ".join(machine.label[i] for i in ids)

    return Cache(entry, WORD_CACHE)


def encode_text(config: str, text: str) -> list[int]:
    cache, library, out = _word_cache(config), library_tokenizer(config), []
    for part, token in special_splitter(config)(text):
        if token is not None:
            out.append(token)
        else:
            for word in word_pieces(library, part):
                out += cache[word][0]
    return out


def decode_ids(config: str, ids: list[int]) -> str:
    """The labels of the path, joined by a space, as the vocabulary has no decoder of its own."""
    label = automaton(config).label
    return " ".join(label[i] for i in ids if i in label)


def encoded(docs: DataFrame, config: str, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256 of every row's whole text.

    `config` is the vocabulary file's content, about two megabytes, sent once to each executor. Words come from caches
    of bounded size. Decoding emits the arc labels of the ids. Null and empty texts have no ids; added strings inside a
    text are one token each; rows that repeat are encoded each. Without `with_ids` the two long columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(config)
    base = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, " + ("ids array<int>, decoded string, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        config = shared.value
        split, cache, library, digest = special_splitter(config), _word_cache(config), library_tokenizer(config), hashlib.sha256
        for batch in batches:
            numbers, labels, ids, counts = [], [], [], []
            for value in batch.column("text").to_pylist():
                found: list[tuple[list[int], str, str]] = []
                for part, token in split(value):
                    found += [([token], str(token), part)] if token is not None else map(cache.__getitem__, word_pieces(library, part))
                counts.append(sum(len(x) for x, _, _ in found))
                numbers.append(" ".join([x for _, x, _ in found if x]))
                labels.append(" ".join([x for _, _, x in found if x]))
                if with_ids:
                    ids.append([i for x, _, _ in found for i in x])
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64())]
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.string())] if with_ids else []
            columns += [pa.array([digest(x.encode("utf-8", "surrogatepass")).hexdigest() for x in xs], pa.string()) for xs in (numbers, labels)]
            names = ["doc_id", "n_tokens", *(["ids", "decoded"] if with_ids else []), "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(compute, schema)
