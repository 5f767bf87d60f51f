"""Operator 10: language-model scoring by prediction by partial matching.

A text is a stream of symbols: the bytes of its words, a terminator after each, and the end of the document. A symbol is coded in a
trie of contexts, the preceding symbols of its word, a start mark of the document's class (language) included, up to `order`
symbols, counted over all training text. It is coded in the longest context that was seen; where it is new there, the model escapes
(method D) to the next shorter one, from which the symbols of the longer context are excluded (their sets are nested, so what is
left is a number of each context). A document's class is coded first, so its score is a probability of the text.

Contexts run over the whole stream, across words (`across`), or end at the word; there a word's cost depends on the class and the word
alone. Either way Spark counts and scores each distinct pair once and sends the figures back to the chunks of documents that hold it.
The trie is a table of (context, symbol) pairs in Spark, of one order at every size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import SPACE_WORDS, Words, id_fold, mix, open_store, release, shared_path, slices, text_bytes, text_or_empty, written

ORDER = 5
#: Pairs of a model that goes to every task; a larger one is joined instead, with the same results.
MAX_PAIRS = 4_000_000
WORD_END, DOC_END, START = 256, 257, 258
ALPHABET = 258
#: Different two last symbols, of 9 bits each.
SUFFIX = 1 << 18
#: Classes with start marks of their own; the others, with the fewest documents, share one.
MAX_CLASSES = 200
#: Bytes of text in a chunk, and symbols of its texts at once.
_CHUNK = 8 << 20
_PIECE = 1 << 20
#: Symbols of the bytes of spaced texts (`spaced`), from 1 on; 0: no symbol.
_SYMBOLS = np.arange(1, 257, dtype=np.int64)
_SYMBOLS[0x20], _SYMBOLS[0x0A] = WORD_END + 1, DOC_END + 1


def pairs_of(words: pa.Array, counts: np.ndarray, classes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair of each symbol of the words, terminators included, with the word of each and its count.

    A pair is the last `order` symbols and the symbol, 9 bits each; 0: no symbol, as before the start mark of the word's class.
    """
    raw, off = text_bytes(words)
    n = len(off) - 1
    size = np.diff(off) + 1
    ends = np.cumsum(size)
    sym = np.full(int(ends[-1]) if n else 0, WORD_END, np.int64)
    keep = np.ones(len(sym), bool)
    keep[ends - 1] = False
    sym[keep] = raw
    sym += 1
    token = np.repeat(np.arange(n), size)
    place = np.arange(len(sym)) - np.repeat(ends - size, size)
    start = START + 1 + classes[token]
    key = np.zeros(len(sym), np.int64)
    for i in range(order, 0, -1):
        back = np.zeros(len(sym), np.int64)
        back[i:] = sym[:-i] if i < len(sym) else sym[:0]
        key = (key << 9) | np.where(place >= i, back, np.where(place == i - 1, start, 0))
    return (key << 9) | sym, token, counts[token]


def spaced(words: Words) -> np.ndarray:
    """The bytes of each row's words, a space after each word and a line feed after the row, neither of which is in a word."""
    size, n = words.ends - words.starts + 1, len(words.off) - 1
    until = np.concatenate([[0], np.cumsum(size)])
    blank = until[1:] - 1 + np.repeat(np.arange(n), words.counts())
    feed = until[words.first[1:]] + np.arange(n)
    out, letter = np.full(int(until[-1]) + n, 0x20, np.uint8), np.ones(int(until[-1]) + n, bool)
    letter[blank] = letter[feed] = False
    out[feed] = 0x0A
    out[letter] = words.raw[SPACE_WORDS[words.raw]]
    return out


def pairs_of_texts(texts: np.ndarray, classes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair of each symbol of spaced texts, their ends included, with its row. Contexts run from the start mark of the class on, across words."""
    size = np.diff(np.flatnonzero(texts == 0x0A), prepend=-1)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(texts)) + order * (row + 1)  # before each text its start mark, and no symbols before that
    every = np.zeros(len(texts) + order * len(size), np.int64)
    every[at] = _SYMBOLS[texts]
    if order:
        every[at[np.cumsum(size) - size] - 1] = START + 1 + classes
    key = every.copy()
    for i in range(1, order + 1):
        key[i:] |= every[:-i] << (9 * i)
    return key[at], row


def in_pieces(texts: np.ndarray, most: int = _PIECE) -> Iterator[tuple[slice, slice]]:
    """Bytes and rows of spaced texts, in pieces of about `most` bytes (a longer text stays whole)."""
    ends = np.flatnonzero(texts == 0x0A) + 1
    row = at = 0
    while row < len(ends):
        to = max(row + 1, int(np.searchsorted(ends, at + most, side="right")))
        yield slice(at, int(ends[to - 1])), slice(row, to)
        row, at = to, int(ends[to - 1])


def read_texts(path: str) -> np.ndarray:
    import zstandard

    store, at = open_store(path)
    with store.open_input_file(at) as f:
        body = f.read()
    with zstandard.ZstdDecompressor().stream_reader(body) as r:
        return np.frombuffer(r.read(), np.uint8)


def end_pairs(order: int) -> np.ndarray:
    """The pair of the end of a document, for each class."""
    return ((START + 1 + np.arange(MAX_CLASSES, dtype=np.int64)) << 9) | (DOC_END + 1) if order else np.full(MAX_CLASSES, DOC_END + 1, np.int64)


def dense(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of symbols after one symbol, from pairs of which the two last matter: a 512 x 512 table."""
    return np.bincount(pair & (SUFFIX - 1), n, SUFFIX).reshape(512, 512)


def log_probability(pair: np.ndarray, n: np.ndarray, after_one: np.ndarray, order: int) -> np.ndarray:
    """log10 of the probability of each distinct pair's symbol. n: counts in training; after_one: `dense` of all pairs. The pairs are all
    those that share their last two contexts' symbols with any of them, so that counts of shorter contexts are sums over them."""
    # of each order, for each pair: count of its symbol, of all symbols and of different ones, and what the context one longer has of them
    counts, total, kinds, held, held_kinds, fits = [], [], [], [], [], []
    last = pair & 511
    one = (pair >> 9) & 511
    no_context = after_one.sum(axis=0)
    for k in range(order + 1):
        if k == 0:
            c, t, d = no_context[last], np.full(len(pair), no_context.sum()), np.full(len(pair), (no_context > 0).sum())
            fit = np.ones(len(pair), bool)
        elif k == 1:
            c, t, d = after_one[one, last], after_one.sum(axis=1)[one], (after_one > 0).sum(axis=1)[one]
            fit = one > 0
        else:
            fit = (pair >> (9 * k)) & 511 > 0
            key = pair & ((1 << (9 * (k + 1))) - 1)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            each = np.bincount(which, n, len(first))
            c = each[which]
            _, of = np.unique(key >> 9, return_inverse=True)
            t = np.bincount(of[first], each)[of]
            d = np.bincount(of[first], each > 0)[of]
        if k >= 1:  # what the symbols of this context count in the next shorter one
            if k == 1:
                held.append((np.where(after_one > 0, no_context, 0).sum(axis=1))[one])
            else:
                held.append(np.bincount(of[first], np.where(each > 0, counts[k - 1][first], 0))[of])
        counts.append(c)
        total.append(t)
        kinds.append(d)
        fits.append(fit & (t > 0))
    out = np.zeros(len(pair))
    open_ = np.ones(len(pair), bool)
    above = np.full(len(pair), -1)
    for k in range(order, -1, -1):
        at = np.flatnonzero(open_ & fits[k])
        c, t, d = counts[k][at], total[k][at], kinds[k][at]
        inner = above[at] == k + 1  # contexts are nested, so the one escaped from is one longer
        if inner.any():
            i = at[inner]
            t[inner] -= held[k][i]
            d = d.astype(np.float64)
            d[inner] -= kinds[k + 1][i]
        # method D: half a count of each different symbol goes to the escape; where all are excluded there is none to leave
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at] += np.where(c > 0, np.log10((2 * c - 1) / (2 * t)), np.where(d > 0, np.log10(d / (2 * t)), 0.0))
        open_[at[c > 0]] = False
        above[at[c == 0]] = k
    out[open_] -= np.log10(max(1, ALPHABET - int((no_context > 0).sum())))
    return out


def chunked(docs: DataFrame, folds: int, fold: int, text: str, doc_id: str, group: str | None, across: bool = False) -> DataFrame:
    """Documents in chunks, each with its own small dictionary. Rows of a chunk: one with doc_ids, held_out, classes, sizes
    and files of the tokens' numbers (`body`) and, for contexts across words, of the spaced texts (`texts`); and one for each distinct class and word with
    its number and its count in training documents."""
    import zstandard

    out = shared_path(docs.sparkSession, "chunk-bodies")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=1)
        store, base = open_store(out)
        store.create_dir(base, recursive=True)
        chunk = TaskContext.get().partitionId() << 24
        names = ["chunk", "number", "class", "word", "n_train", "doc_ids", "held_out", "classes", "sizes", "body", "texts"]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.string())
        held: list[tuple] = []
        n_bytes = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, kinds, words, n_train, counts, numbers, ids, outs, classes, sizes, texts = zip(*held, strict=True)
            keys, kinds, n_train, counts = map(np.concatenate, (keys, kinds, n_train, counts))
            _, where, number = np.unique(keys, return_index=True, return_inverse=True)
            n = len(where)
            by = np.argsort(-np.bincount(number, counts, n), kind="stable")  # frequent tokens get small numbers
            rank = np.empty(n, np.int64)
            rank[by] = np.arange(n)
            number, where = rank[number], where[by]
            at = np.cumsum([0, *map(len, words)])
            tokens = np.concatenate([number[a + x] for a, x in zip(at, numbers, strict=False)])
            name = f"/{chunk}-{uuid.uuid4().hex[:12]}"  # a name of this attempt; the committed row tells which counts
            with store.open_output_stream(f"{base}{name}.zst", compression=None) as f:
                f.write(press.compress(tokens.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes()))
            if across:
                with store.open_output_stream(f"{base}{name}.texts.zst", compression=None) as f:
                    f.write(press.compress(np.concatenate(texts).tobytes()))
            head = ([chunk], [None], [None], [None], [None], [[x for i in ids for x in i]], [np.concatenate(outs).tolist()], [np.concatenate(classes).tolist()], [np.concatenate(sizes).tolist()], [f"{out}{name}.zst"], [f"{out}{name}.texts.zst" if across else None])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(head, types, strict=True)], names=names)
            sums = np.bincount(number, n_train, n).astype(np.int64)
            spelled = pa.concat_arrays(words)
            for a in range(0, n, 50_000):
                w = where[a : a + 50_000]
                cols = [pa.array(np.full(len(w), chunk)), pa.array(np.arange(a, a + len(w), dtype=np.int32)), pa.array(kinds[w].astype(np.int32)), spelled.take(pa.array(w)), pa.array(sums[a : a + len(w)])]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(w), t) for t in types[5:]]], names=names)

        for b in slices(batches, "text"):
            words = Words(b.column(1), SPACE_WORDS)
            out_ = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            size, classes = words.counts(), b.column(3).to_numpy()
            kind = np.repeat(classes, size)
            keys, where, number = np.unique(mix(words.hash + kind.astype(np.uint64)), return_index=True, return_inverse=True)
            n_train = np.bincount(number[np.repeat(~out_, size)], minlength=len(keys))
            held.append((keys, kind[where], words.strings(where), n_train, np.bincount(number, minlength=len(keys)), number.astype(np.int32), b.column(0).to_pylist(), out_, classes, size, spaced(words) if across else None))
            n_bytes += len(words.raw)
            if n_bytes >= _CHUNK:
                yield from flush()
                held, n_bytes, chunk = [], 0, chunk + 1
        if held:
            yield from flush()

    kind = F.lit(0)
    if group:
        value = F.coalesce(F.col(group).cast("string"), F.lit(""))
        largest = [r[0] for r in docs.groupBy(value.alias("v")).count().orderBy(F.desc("count"), "v").limit(MAX_CLASSES - 1).collect()]
        for i, v in enumerate(largest):
            kind = F.when(value == v, i + 1).otherwise(kind)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), (id_fold(doc_id, folds) == fold).alias("held_out"), kind.cast("int").alias("class"))
    return written(d.mapInArrow(cut, "chunk long, number int, class int, word string, n_train long, doc_ids array<long>, held_out array<boolean>, classes array<int>, sizes array<long>, body string, texts string"), "chunks")


def pair_counts(words: DataFrame, ends: np.ndarray, order: int) -> DataFrame:
    """pair, n: the distinct pairs of a table of class, word, c (n of a pair met outside of training alone: 0), and those of the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if n:
                t = pa.Table.from_batches(held).combine_chunks()
                pair, _, c = pairs_of(t.column(0).chunk(0), t.column(2).to_numpy(), t.column(1).to_numpy(), order)
                u, where = np.unique(pair, return_inverse=True)
                sums = np.bincount(where, c, len(u)).astype(np.int64)
                del t, pair, c, where
                for a in range(0, len(u), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(u[a : a + 50_000]), pa.array(sums[a : a + 50_000])], names=["pair", "n"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 100_000:
                yield from out()
                held, n = [], 0
        yield from out()
        release()

    own = words.sparkSession.createDataFrame([(int(p), int(c)) for p, c in zip(end_pairs(order), ends, strict=True)], "pair long, n long")
    return words.select("word", "class", "c").mapInArrow(count, "pair long, n long").unionByName(own).groupBy("pair").agg(F.sum("n").alias("n"))


def text_pairs(heads: DataFrame, order: int, counted: bool = True) -> DataFrame:
    """pair, n: the distinct pairs of the chunks' texts (n of a pair met outside of training alone: 0); or, uncounted, chunk, pair: those of each chunk."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, texts = b.column(0)[i].as_py(), read_texts(b.column(3)[i].as_py())
                out, classes = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2))
                found: tuple[list, list] = ([], [])  # of training texts, and of the others
                for part, rows in in_pieces(texts):
                    pair, row = pairs_of_texts(texts[part], classes[rows], order)
                    held_out = out[rows].astype(bool)[row]
                    found[0].append(pair[~held_out])
                    found[1].append(np.unique(pair[held_out]))
                u, n = np.unique(np.concatenate(found[0]), return_counts=True)
                new = np.setdiff1d(np.concatenate(found[1]), u)
                found = None
                u, n = np.concatenate([u, new]), np.concatenate([n, np.zeros(len(new), np.int64)])
                for a in range(0, len(u), 50_000):
                    p = pa.array(u[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([p, pa.array(n[a : a + 50_000])], names=["pair", "n"]) if counted else pa.RecordBatch.from_arrays([pa.array(np.full(len(p), chunk)), p], names=["chunk", "pair"])
        release()

    found = heads.select("chunk", "held_out", "classes", "texts").mapInArrow(find, "pair long, n long" if counted else "chunk long, pair long")
    return found.groupBy("pair").agg(F.sum("n").alias("n")) if counted else found


def model_of(words: DataFrame, ends: np.ndarray, order: int = ORDER) -> DataFrame:
    """pair, p of the words' pairs and of those of the ends, as `rated`."""
    return rated(pair_counts(words, ends, order), order)


def rated(counts: DataFrame, order: int) -> DataFrame:
    """pair, p: the log10 probability of each pair's symbol after its context. Pairs are dealt by their two last context symbols, so a task has
    the counts of all longer contexts; those after one symbol and after none are a table of bounded size that all tasks get."""
    spark = counts.sparkSession
    pairs = written(counts, "pairs")
    few = pairs.groupBy(F.col("pair").bitwiseAND(SUFFIX - 1).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    after_one = spark.sparkContext.broadcast(dense(few.column(0).to_numpy(), few.column(1).to_numpy()))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            pair, n = t.column(0).to_numpy(), t.column(1).to_numpy()
            p = log_probability(pair, n, after_one.value, order)
            for a in range(0, len(pair), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[a : a + 50_000]), pa.array(p[a : a + 50_000])], names=["pair", "p"])
        release()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 400_000)
    dealt = pairs.repartition(tasks, F.shiftright("pair", 9).bitwiseAND(SUFFIX - 1))
    return written(dealt.mapInArrow(rate, "pair long, p double"), "model", replaces=[pairs])


def table_of(model: DataFrame):
    """The model as two arrays, by pair, for every task."""
    t = model.toArrow()
    by = np.argsort(t.column(0).to_numpy())
    return model.sparkSession.sparkContext.broadcast((t.column(0).to_numpy()[by], t.column(1).to_numpy()[by].astype(np.float64)))


def spelled(words: DataFrame, model: DataFrame, order: int, most: int = MAX_PAIRS) -> DataFrame:
    """word, class, c, s: the log10 probability of each word. A model of at most `most` pairs goes to every task; a larger one is joined."""
    if model.count() <= most:
        table = table_of(model)

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, p = table.value
            for b in batches:
                if b.num_rows:
                    pair, token, _ = pairs_of(b.column(0), b.column(2).to_numpy(), b.column(1).to_numpy(), order)
                    s = np.bincount(token, p[np.searchsorted(keys, pair)], b.num_rows)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(s)], names=["word", "class", "c", "s"])

        return words.select("word", "class", "c", "all").mapInArrow(rate, "word string, class int, c long, s double")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pair, token, _ = pairs_of(b.column(0), b.column(2).to_numpy(), b.column(1).to_numpy(), order)
                yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(token)), b.column(1).take(pa.array(token)), pa.array(pair)], names=["name", "class", "pair"])

    names = words.select("word", "class", "c", F.xxhash64("word").alias("name"))
    # a frequent pair stands in many words; each task counts a word's own ones first
    places = names.mapInArrow(spell, "name long, class int, pair long").groupBy("pair", "name", "class").count()
    sums = places.join(model, "pair").groupBy("name", "class").agg(F.sum(F.col("p") * F.col("count")).alias("s"))
    return words.withColumn("name", F.xxhash64("word")).join(sums, ["name", "class"]).select("word", "class", F.col("all").alias("c"), "s")


def score(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = ORDER, most: int = MAX_PAIRS, text: str = "text", doc_id: str = "doc_id", group: str | None = "lang", across: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens (words and the end), n_known, train_tokens, base_score, score.

    score: log10 probability of the class and of all symbols of the text's words and its end, each by the trie of contexts of up to
    `order` symbols (6 at most), across words or within each. The model and the counts come from all documents outside the fold, each word by its frequency. Null or empty texts are the end alone.
    Rows are scored one by one; repeated ones repeat, and each counts in training. group: a column whose values are
    the classes (null counts as empty text; from the 200th class on, by number of documents, classes share one start mark), or None. Equal texts of
    different classes differ by the class's own cost. Without training documents every token is new.
    """
    import zstandard

    spark = docs.sparkSession
    chunks = chunked(docs, folds, fold, text, doc_id, group, across)
    heads = chunks.filter(F.col("body").isNotNull()).select("chunk", "doc_ids", "held_out", "classes", "sizes", "body", "texts")
    entries = chunks.filter(F.col("word").isNotNull()).select("chunk", "number", "class", "word", "n_train")
    # dealt by word once, for the counts of a class and of all classes
    dealt = entries.select("class", "word", "n_train").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    by_class = dealt.groupBy("class", "word").agg(F.sum("n_train").alias("c"))
    by = [] if across else [F.collect_list(F.struct("class", "c")).alias("by")]
    everywhere = written(by_class.groupBy("word").agg(F.sum("c").alias("all"), *by), "everywhere")
    texts = heads.select(F.explode(F.arrays_zip("held_out", "classes")).alias("d")).filter(~F.col("d.held_out")).groupBy("d.classes").count()
    n_texts = np.zeros(MAX_CLASSES, np.int64)
    for k, n in texts.collect():
        n_texts[k] = n
    ends = int(n_texts.sum())
    distinct, n_words = everywhere.filter(F.col("all") > 0).agg(F.count("*"), F.coalesce(F.sum("all"), F.lit(0))).first()
    distinct += 1 if ends else 0
    total = int(n_words) + ends
    end = np.zeros(MAX_CLASSES)
    prior = np.log10((n_texts + 1.0) / (ends + MAX_CLASSES))
    table = None
    if across:
        model = rated(text_pairs(heads, order), order)
        figures = entries.select("chunk", F.col("number").cast("long"), "word").join(everywhere.select("word", F.col("all").alias("c")), "word").select("chunk", "number", "c", F.lit(0.0).alias("s"))
        if model.count() <= most:
            table = table_of(model)
        else:  # a chunk's pairs come among its figures, by the complements of their numbers, which are negative
            met = text_pairs(heads, order, counted=False).join(model, "pair")
            figures = figures.unionByName(met.select("chunk", F.bitwise_not("pair").alias("number"), F.lit(0).cast("long").alias("c"), F.col("p").alias("s")))
    else:
        words = everywhere.select("word", "all", F.explode("by").alias("b")).select("word", "all", "b.class", "b.c")
        model = model_of(words, n_texts, order)
        p_end = {r["pair"]: r["p"] for r in model.filter(F.col("pair").isin([int(p) for p in set(end_pairs(order).tolist())])).collect()}
        end[:] = [p_end[int(p)] for p in end_pairs(order)]
        figures = entries.select("chunk", F.col("number").cast("long"), "class", "word").join(spelled(words, model, order, most), ["class", "word"]).select("chunk", "number", "c", "s")
    own = ["doc_ids", "held_out", "classes", "sizes", "body", "texts"]
    # a chunk's head and then its figures by number, so that a task holds one batch and the figures of the chunk at hand
    # empty arrays, not nulls: a run of null lists takes time with the square of a batch on its way to Arrow
    blank = [(F.lit(None).cast("string") if c in ("body", "texts") else F.array().cast(heads.schema[c].dataType)).alias(c) for c in own]
    rows = figures.select("*", *blank).unionByName(heads.select("chunk", F.lit(None).cast("long").alias("number"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("s"), *own))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").sortWithinPartitions("chunk", F.asc_nulls_first("number"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = lambda c: np.log10((c + 1) / (total + distinct + 1))
        head: list = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def whole(path: str, kind: np.ndarray, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
            texts, out = read_texts(path), np.zeros(len(kind))
            for part, rows in in_pieces(texts):
                pair, row = pairs_of_texts(texts[part], kind[rows], order)
                pair, of = np.unique(pair, return_inverse=True)  # sorted, so that looking up runs through the table in order
                out[rows] = np.bincount(row, p[np.searchsorted(keys, pair)][of], rows.stop - rows.start)
            return out

        def settle() -> Iterator[pa.RecordBatch]:
            ids, out, kind, sizes, path, texts = head
            m = int(sizes.sum())
            store, path = open_store(path)
            with store.open_input_file(path) as f:
                body = f.read()
            number = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=4 * m + 64), np.uint8).reshape(4, m).T.copy().view("<u4").ravel() if m else np.zeros(0, np.int64)
            place, c, s = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
            cost = None
            if across:
                n = int(np.searchsorted(place, 0))  # pairs come first, the largest ahead
                cost = whole(texts, kind, *(table.value if table else (~place[:n][::-1], s[:n][::-1])))
                c, s = c[n:], s[n:]
            row = np.repeat(np.arange(len(sizes)), sizes)
            w = lambda x: np.bincount(row, x[number], len(sizes)) if m else np.zeros(len(sizes))
            known = w((c > 0).astype(float)) + (1 if ends else 0)
            cols = [ids, out, pa.array(sizes + 1), pa.array(known.astype(np.int64)), pa.array(np.full(len(sizes), total, np.int64)), pa.array(w(base(c)) + base(ends)), pa.array((cost if across else w(s) + end[kind]) + prior[kind])]
            for k in range(0, len(sizes), 10_000):
                yield pa.RecordBatch.from_arrays([x.slice(k, 10_000) for x in cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column(8).is_valid())).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if b > a:  # from a head on, or the rest of the chunk at hand
                    if a in starts:
                        ids, out, kind, sizes = (batch.column(k)[a].values for k in range(4, 8))
                        head, a = [ids, out, kind.to_numpy(), sizes.to_numpy(), batch.column(8)[a].as_py(), batch.column(9)[a].as_py()], a + 1
                    held.append((batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False), batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False)))
                if b in starts and head:
                    yield from settle()
                    held = []
        if head:
            yield from settle()
        release()

    return rows.mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
