"""Language-model scores from a log-bilinear neural model trained by noise-contrastive estimation in numpy.

A text's tokens are its words and one end. The WORDS most frequent tokens are the model's words, in classes of MEMBERS of
like frequency; all other tokens share FORMS classes by their form. log p(token | context) is log p(class | context),
normalised over the classes, plus, for a word, log p(word | class, context), normalised over the class's words, plus, for
another token, the log of its add-0.5 share of its class, unseen tokens included. So the model covers every token, and
both normalisations are batched matrix products of a few hundred columns, whatever the number of words.

Counts: slices of texts send their tokens' counts to buckets of names, which add them up (all training tokens).
Preparing: texts become the model's symbols once, for training and scoring; tokens outside the broadcast table of TABLE
frequent counts ask their bucket.
Training: every training text is used once, in ROUNDS rounds. Texts are dealt to learners of LEARNER_TOKENS tokens by a hash
and put in its order, so that the result doesn't depend on how the rows lie in files. In a round, each learner trains from
the round's parameters; the results are averaged by tokens in a tree. Noise classes are shared by a minibatch, noise words
are drawn for each token from its own class.
Scoring: what the buckets answer and the symbols meet by slice.

Defined results: a null or empty text is its end token alone; a null doc_id counts as an empty text for the fold;
repeated rows return as often as they occur; without training texts every token is unseen and N is 0; other columns,
whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, CACHE_LENGTH, Scratch, slices, table
from .packed import bucket_count, by_bucket, pack, read_rows, runs

FORMS = 64
WORDS, MEMBERS = 16_384, 128
CONTEXT = 2
WIDTH = 16
#: Noise classes for a minibatch, and noise words for a token.
NOISE, NOISE_WORDS = 32, 2
MINIBATCH = 2048
RATE = 0.1
#: The share of the training texts, in sixteenths, that each round uses.
ROUNDS = (2, 4, 10)
LEARNER_TOKENS = 1 << 22
#: Tasks that learners are dealt to; beyond, a task takes several, one after the other.
MOST_TASKS = 1 << 15
#: Entries of the broadcast table of frequent tokens' counts, at most.
TABLE = 65_536
#: Rows of parameters that one task or the driver averages, at most.
FAN_IN = 16
END = b"\n"  # no word has a white space


class Vocabulary(dict):
    """A worker's tokens, numbered as they come; a token's name is a hash whose lowest bits are the token's class.

    Whatever depends on a token's name only is kept in tables by number, so it is looked up once a distinct token.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.clear()
        self.bytes = 0
        self.fresh: list[int] = []
        self.names = np.zeros(0, dtype=np.uint64)
        self.owner, self.tables = None, {}

    def __missing__(self, token: bytes) -> int:
        from xxhash import xxh64_intdigest

        last = token.rstrip(b".,;:!?")[-1:] or b"@"
        form = last[0] % 32 + 32 * (not token.isascii())
        self.fresh.append(xxh64_intdigest(token, 11) // FORMS * FORMS + form)
        self[token] = n = len(self)
        self.bytes += len(token)
        return n

    def numbers(self, texts):
        """(numbers, tokens in each text) of an Arrow column of texts, lower-cased (A-Z), each ended; null is empty.

        Arrow splits at ASCII white space and finds the distinct words, so that only these are looked up.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self) > CACHE_ENTRIES or self.bytes > CACHE_ENTRIES * CACHE_LENGTH:
            self.forget()
        trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        words = pc.ascii_split_whitespace(trimmed)
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes[pc.equal(trimmed, "").to_numpy(zero_copy_only=False)] = 0  # splitting gives one empty word
        flat = words.flatten()
        flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        distinct = np.fromiter(map(self.__getitem__, flat.dictionary.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(flat.dictionary))
        numbers = distinct[flat.indices.to_numpy(zero_copy_only=False)]
        numbers = np.insert(numbers, np.cumsum(sizes), self[END])
        if self.fresh:
            self.names = np.concatenate([self.names, np.array(self.fresh, dtype=np.uint64)])
            self.fresh = []
        return numbers, sizes + 1

    def table(self, owner: str, which: str, make):
        """make(names) for all names so far; made for new names only. Tables of another owner are dropped."""
        import numpy as np

        if self.owner != owner:
            self.owner, self.tables = owner, {}
        old = self.tables.get(which)
        if old is None or len(old) < len(self.names):
            more = make(self.names[0 if old is None else len(old) :])
            self.tables[which] = more if old is None else np.concatenate([old, more])
        return self.tables[which]


_VOCABULARY = Vocabulary()


def add_up(names, counts):
    """Distinct names and their summed counts."""
    import numpy as np

    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    new = np.nonzero(np.append(True, names[1:] != names[:-1]))[0] if len(names) else np.zeros(0, dtype=np.int64)
    return names[new], np.add.reduceat(counts, new) if len(new) else counts


def fold(key: str):
    """crc32 of the id as text, modulo 5; held-out rows have 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


# counts


def count_tokens(train: DataFrame, buckets: int) -> DataFrame:
    """(bucket, names, counts, total, distinct, sizes): packed counts of all tokens of (text); sizes: how many of the bucket's
    counts have each bit length."""

    def send(batches):
        import numpy as np

        for batch in batches:
            for part in slices(batch):
                numbers, _ = _VOCABULARY.numbers(part.column("text"))
                counts = np.bincount(numbers)
                own = np.nonzero(counts)[0]
                names, counts = _VOCABULARY.names[own], counts[own]
                yield from by_bucket((names // np.uint64(FORMS)) % np.uint64(buckets), buckets, 0, names=names, counts=counts.astype("<u4"))

    def receive(batches):
        import numpy as np
        import pyarrow as pa

        for bucket, rows in runs(batches, "bucket", ["names", "counts"]):
            names = np.concatenate([np.frombuffer(x, "<u8") for x, _ in rows])
            counts = np.concatenate([np.frombuffer(x, "<u4") for _, x in rows]).astype(np.int64)
            names, counts = add_up(names, counts)
            form = (names % np.uint64(FORMS)).astype(np.int64)
            sizes = np.bincount(np.frexp(counts.astype(np.float64))[1], minlength=64)
            forms = np.stack([np.bincount(form, counts, FORMS), np.bincount(form, minlength=FORMS)]).astype(np.int64)
            columns = [pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (names.tobytes(), counts.tobytes()))]
            columns += [pa.array([int(x)], pa.int64()) for x in (counts.sum(), len(counts))] + [pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (sizes, forms)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "names", "counts", "total", "kinds", "sizes", "forms"])

    sent = train.select("text").mapInArrow(send, "bucket int, slice long, names binary, counts binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(receive, "bucket int, names binary, counts binary, total long, kinds long, sizes array<long>, forms array<long>")


class Statistics:
    """What the corpus's counts say as a whole: N, V, the frequent tokens, and the classes' totals."""

    def __init__(self, counted: DataFrame):
        import numpy as np

        self.total, self.kinds = (x or 0 for x in counted.agg(F.sum("total"), F.sum("kinds")).first())

        def added(column, n):
            each = counted.select(F.posexplode(column).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # n rows
            out = np.zeros(n, dtype=np.int64)
            for i, x in each:
                out[i] = x
            return out

        sizes = added("sizes", 64)
        forms = added("forms", 2 * FORMS)
        above = np.cumsum(sizes[::-1])[::-1]  # counts of at least so many bits
        bits = int(np.argmax(above <= TABLE)) if self.total else 64
        least = 1 << max(bits - 1, 0)

        def frequent(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for names, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    names, counts = np.frombuffer(names, "<u8"), np.frombuffer(counts, "<i8")
                    top = counts >= least
                    if top.any():
                        yield pa.RecordBatch.from_arrays([pa.array([x[top].tobytes()], pa.binary()) for x in (names, counts)], names=["names", "counts"])

        rows = counted.select("names", "counts").mapInArrow(frequent, "names binary, counts binary").collect()  # TABLE entries at most
        names = np.frombuffer(b"".join(r[0] for r in rows), "<u8")
        counts = np.frombuffer(b"".join(r[1] for r in rows), "<i8")
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order]
        # the model's words: the most frequent tokens by count, then name
        order = np.lexsort((self.names, -self.counts))[:WORDS]
        by_name = np.argsort(self.names[order])
        self.word_names, self.word_numbers = self.names[order][by_name], by_name.astype(np.int64)
        words = self.counts[order]
        form = (self.names[order] % np.uint64(FORMS)).astype(np.int64)
        self.form_total = forms[:FORMS] - np.bincount(form, words, FORMS).astype(np.int64)
        self.form_kinds = forms[FORMS:] - np.bincount(form, minlength=FORMS)
        self.weights = np.append(self.form_total, words) + 0.5


def symbols_of(names, word_names, word_numbers):
    """Symbol of each name: its form's number, or FORMS plus its number among the words, which are sorted by frequency."""
    import numpy as np

    out = (names % np.uint64(FORMS)).astype(np.uint16)
    if len(word_names):
        at = np.minimum(np.searchsorted(word_names, names), len(word_names) - 1)
        known = word_names[at] == names
        out[known] = FORMS + word_numbers[at[known]]
    return out


# training


class Model:
    """Log-bilinear with classes: h = sum_i position_i * left[context_i]; a class scores h . right[class] + bias, a word of it
    h . word_right[word] + word_bias. weights: how often each symbol occurs."""

    def __init__(self, weights, members: int | None = None, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        n, self.words, self.members = len(weights), len(weights) - FORMS, members or MEMBERS
        self.begins = np.arange(0, self.words, self.members)  # each word class's first word
        classes = np.append(weights[:FORMS], np.add.reduceat(weights[FORMS:], self.begins) if self.words else [])
        self.class_share = classes / classes.sum()
        of = np.arange(self.words) // self.members
        self.word_share = weights[FORMS:] / classes[FORMS + of] if self.words else np.zeros(0)
        self.left = rng.normal(0, 0.3, (n + 1, WIDTH)).astype(np.float32)  # the last row stands before a text
        self.position = np.ones((CONTEXT, WIDTH), dtype=np.float32)
        self.right = np.zeros((len(classes), WIDTH), dtype=np.float32)
        self.bias = np.log(self.class_share).astype(np.float32)
        self.word_right = np.zeros((self.words, WIDTH), dtype=np.float32)
        self.word_bias = np.log(self.word_share).astype(np.float32)

    def arrays(self):
        return [self.left, self.position, self.right, self.bias, self.word_right, self.word_bias]

    def vector(self):
        import numpy as np

        return np.concatenate([x.ravel() for x in self.arrays()])

    def load(self, vector):
        at = 0
        for x in self.arrays():
            x[...] = vector[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def hidden(self, context):
        return sum(self.position[i] * self.left[context[:, i]] for i in range(CONTEXT))

    @staticmethod
    def _norms(h, right, bias):
        """log sum exp of the rows of h @ right.T + bias."""
        import numpy as np

        out = np.empty(len(h), dtype=np.float32)
        for a in range(0, len(h), 1024):
            s = h[a : a + 1024] @ right.T
            s += bias
            top = s.max(axis=1)
            s -= top[:, None]
            np.exp(s, out=s)
            out[a : a + 1024] = top + np.log(s.sum(axis=1))
        return out

    def log_probabilities(self, context, target):
        """Natural logs of the symbols; equal contexts are computed once for the classes."""
        import numpy as np

        n = len(self.left)
        key = context[:, 0].astype(np.int64)
        for i in range(1, CONTEXT):
            key = key * n + context[:, i]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        h = self.hidden(context[first])
        norm = self._norms(h, self.right, self.bias)
        target = target.astype(np.int64)
        word = target - FORMS
        kind = np.where(word < 0, target, FORMS + word // self.members)
        out = np.einsum("ij,ij->i", h[back], self.right[kind]) + self.bias[kind] - norm[back]
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(FORMS, len(self.bias) + 1))
        for c, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                at = order[a:b]
                own = slice(c * self.members, min((c + 1) * self.members, self.words))
                own_h = h[back[at]]
                scores = np.einsum("ij,ij->i", own_h, self.word_right[word[at]]) + self.word_bias[word[at]]
                out[at] += scores - self._norms(own_h, self.word_right[own], self.word_bias[own])
        return out


def contexts(symbols, sizes, before: int):
    """The CONTEXT symbols ahead of each token, `before` where the text begins."""
    import numpy as np

    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(symbols))
    out = np.empty((len(symbols), CONTEXT), dtype=np.int64)
    for i in range(CONTEXT):
        out[:, i] = np.where(at - i - 1 >= begin, np.roll(symbols, i + 1), before)
    return out


class Trainer:
    """Noise-contrastive estimation of the classes and of the words in their classes; AdaGrad with one rate a row."""

    def __init__(self, model: Model, seed: int):
        import numpy as np

        self.model, self.rng = model, np.random.default_rng(seed)
        self.log_noise = np.log(model.class_share * NOISE).astype(np.float32)
        self.log_noise_words = np.log(model.word_share * NOISE_WORDS).astype(np.float32)
        self.edges, self.word_edges = np.cumsum(model.class_share), np.cumsum(model.word_share)
        self.squares = [np.full(len(x), 1e-4, dtype=np.float32) for x in model.arrays()]
        self.seen = 0

    def step(self, context, target) -> None:
        import numpy as np

        m, rate = self.model, 1 / len(target)
        word = target - FORMS
        kind = np.where(word < 0, target, FORMS + word // m.members)
        left = [m.left[context[:, i]] for i in range(CONTEXT)]
        h = sum(m.position[i] * left[i] for i in range(CONTEXT))
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(m.bias) - 1)
        right, noise = m.right[kind], m.right[drawn]
        up = np.einsum("ij,ij->i", h, right)
        up += (m.bias - self.log_noise)[kind]
        up = 1 / (1 + np.exp(np.minimum(up, 30)))  # 1 - sigmoid
        down = h @ noise.T
        down += (m.bias - self.log_noise)[drawn]
        down = -1 / (1 + np.exp(-np.clip(down, -30, 30)))
        gh = up[:, None] * right
        gh += down @ noise
        self.update(2, 3, np.concatenate([kind, drawn]), np.concatenate([up[:, None] * h, down.T @ h]), np.concatenate([up, down.sum(axis=0)]), rate)
        some = np.nonzero(word >= 0)[0]
        if len(some):
            w, hw = word[some], h[some]
            begin = w // m.members  # shares of a class's words sum to 1, so the class's number is where they begin
            noise_words = np.searchsorted(self.word_edges, begin[:, None] + self.rng.random((len(w), NOISE_WORDS)))
            last = np.minimum((begin + 1) * m.members, m.words)[:, None] - 1
            at = np.concatenate([w[:, None], np.clip(noise_words, (begin * m.members)[:, None], last)], axis=1)
            rows = m.word_right[at]
            scores = np.einsum("ijk,ik->ij", rows, hw)
            scores += (m.word_bias - self.log_noise_words)[at]
            push = -1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            push[:, 0] += 1
            gh[some] += np.einsum("ij,ijk->ik", push, rows)
            self.update(4, 5, at.ravel(), (push[:, :, None] * hw[:, None, :]).reshape(-1, WIDTH), push.ravel(), rate)
        push = np.concatenate([gh * m.position[i] for i in range(CONTEXT)])
        gposition = np.stack([(gh * left[i]).sum(axis=0) for i in range(CONTEXT)])
        self.update(0, None, np.concatenate([context[:, i] for i in range(CONTEXT)]), push, None, rate)
        self.climb(m.position, self.squares[1], slice(None), gposition * np.float32(rate))
        self.seen += len(target)

    def update(self, table: int, bias: int | None, rows, push, more, rate: float) -> None:
        """Adds up the gradients of equal rows and climbs by them."""
        import numpy as np

        order = np.argsort(rows)
        rows = rows[order]
        first = np.nonzero(np.append(True, rows[1:] != rows[:-1]))[0]
        own, arrays = rows[first], self.model.arrays()
        self.climb(arrays[table], self.squares[table], own, np.add.reduceat(push[order], first, axis=0) * np.float32(rate))
        if bias is not None:
            self.climb(arrays[bias], self.squares[bias], own, np.add.reduceat(more[order], first) * np.float32(rate))

    @staticmethod
    def climb(x, squares, rows, gradient) -> None:
        import numpy as np

        wide = gradient.ndim == 2
        squares[rows] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1] if wide else gradient * gradient
        step = RATE / np.sqrt(squares[rows])
        x[rows] += gradient * step[:, None] if wide else gradient * step


def learner_rows(prepared: DataFrame, share: tuple[int, int], learners: int) -> DataFrame:
    """(learner, place, symbols) of the training texts of the shares, by learner in their order."""

    def pick(batches):
        import numpy as np
        import pyarrow as pa

        for blob in (x for batch in batches for x in batch.column(0).to_pylist()):
            docs = pa.ipc.open_stream(blob).read_all()
            place = docs.column("place").to_numpy()
            mine = docs.column("train").to_numpy(zero_copy_only=False) & (place % 16 >= share[0]) & (place % 16 < share[1])
            if mine.any():
                docs, place = docs.filter(pa.array(mine)), place[mine]
                whose = pa.array((place // 16 % learners).astype(np.int32))
                yield from pa.Table.from_arrays([whose, pa.array(place), docs.column("symbols")], names=["learner", "place", "symbols"]).to_batches()

    rows = prepared.where("keys is not null").select("keys").mapInArrow(pick, "learner int, place long, symbols binary")
    return rows.repartition(min(learners, MOST_TASKS), "learner").sortWithinPartitions("learner", "place", "symbols")


def train(prepared: DataFrame, stats: Statistics) -> Model:
    """The model after ROUNDS over the training texts."""
    import numpy as np

    spark = prepared.sparkSession
    model = Model(stats.weights)
    if not stats.total:
        return model
    learners = max(1, -(-stats.total // LEARNER_TOKENS))
    begin = 0
    for round_, share in enumerate(ROUNDS):
        told = spark.sparkContext.broadcast((stats.weights, model.members, model.vector()))

        def learn(batches, told=told, round_=round_):
            import pyarrow as pa

            weights, members, vector = told.value

            def minibatches(rows):
                symbols = [np.frombuffer(x, "<u2") for x in rows]
                sizes = np.array([len(x) for x in symbols])
                target = np.concatenate(symbols).astype(np.int64)
                context = contexts(target, sizes, len(weights))
                order = trainer.rng.permutation(len(target))
                for a in range(0, len(order), MINIBATCH):
                    at = order[a : a + MINIBATCH]
                    trainer.step(context[at], target[at])

            def result():
                body = trainer.model.vector().tobytes()
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([trainer.seen], pa.int64()), pa.array([body], pa.binary())], names=["part", "n", "body"])

            at, trainer, held, size = None, None, [], 0
            for batch in batches:
                for learner, symbols in zip(batch.column("learner").to_pylist(), batch.column("symbols").to_pylist()):
                    if learner != at:
                        if held:
                            minibatches(held)
                            held, size = [], 0
                        if trainer:
                            yield result()
                        at, trainer = learner, Trainer(Model(weights, members).load(vector), 1000 * round_ + learner)
                    held.append(symbols)
                    size += len(symbols)
                    if size > 1 << 20:
                        minibatches(held)
                        held, size = [], 0
            if held:
                minibatches(held)
            if trainer:
                yield result()

        learnt = learner_rows(prepared, (begin, begin + share), learners).mapInArrow(learn, "part long, n long, body binary")
        begin += share
        rows = sorted(averaged(learnt, learners).collect(), key=lambda r: r["part"])  # FAN_IN rows at most
        n = sum(r["n"] for r in rows)
        if n:
            model.load(sum(np.frombuffer(r["body"], np.float32).astype(np.float64) * r["n"] for r in rows) / n)
        told.unpersist()
    return model


def averaged(learnt: DataFrame, parts: int) -> DataFrame:
    """The rows' averages, weighted by n, in groups of FAN_IN, until there are FAN_IN groups at most."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([(body / n).astype(np.float32).tobytes()], pa.binary())], names=["part", "n", "body"])

        at, n, body = None, 0, None
        for batch in batches:
            for group, k, own in read_rows(batch, "part", "n", "body"):
                if group != at and at is not None:
                    yield row()
                    n, body = 0, None
                at = group
                more = np.frombuffer(own, np.float32).astype(np.float64) * k
                n, body = n + k, more if body is None else body + more
        if at is not None:
            yield row()

    while parts > FAN_IN:
        grouped = learnt.select(F.expr(f"part div {FAN_IN}").alias("part"), "n", "body", F.col("part").alias("order"))
        learnt = grouped.repartition("part").sortWithinPartitions("part", "order").drop("order").mapInArrow(sums, "part long, n long, body binary")
        parts = -(-parts // FAN_IN)
    return learnt


# scoring


def prepare(docs: DataFrame, stats: Statistics, buckets: int) -> DataFrame:
    """Packed rows for (key, train, place, text): a slice's documents, with their symbols and what is known of them, as one
    blob in `keys`, and its names outside the table for each bucket."""
    told = docs.sparkSession.sparkContext.broadcast((uuid4().hex, stats.names, stats.counts, stats.word_names, stats.word_numbers, stats.form_total, stats.form_kinds))

    def send(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        owner, names_, counts_, word_names, word_numbers, form_total, form_kinds = told.value
        logs = np.log10(counts_ + 0.5)
        share = np.log10(form_total + 0.5 * (form_kinds + 1))
        slice_id = TaskContext.get().partitionId() << 32

        def log_count(names):  # NaN: not in the table
            out = np.full(len(names), np.nan)
            if len(names_):
                at = np.minimum(np.searchsorted(names_, names), len(names_) - 1)
                known = names_[at] == names
                out[known] = logs[at[known]]
            return out

        def symbol(names):
            return symbols_of(names, word_names, word_numbers)

        def log_share(names):  # of the form, 0 for words
            own = symbol(names)
            return np.where(own < FORMS, share[np.minimum(own, FORMS - 1)], 0)

        for batch in batches:
            for part in slices(batch):
                tokens, sizes = _VOCABULARY.numbers(part.column("text"))
                text = np.repeat(np.arange(len(sizes)), sizes)
                own = _VOCABULARY.table(owner, "symbols", symbol)[tokens]
                log = _VOCABULARY.table(owner, "logs", log_count)[tokens]
                minus = _VOCABULARY.table(owner, "shares", log_share)[tokens]
                rare = np.isnan(log)
                base = np.where(rare, 0, log)
                n = len(sizes)
                sums = [np.bincount(text, w, n) for w in (~rare, base, np.where(own < FORMS, base - minus, 0))]
                slice_id += 1
                edges = pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(sizes)]).astype("<i4").tobytes())
                symbols = pa.BinaryArray.from_buffers(pa.binary(), n, [None, edges, pa.py_buffer(own.astype("<u2").tobytes())])
                columns = [part.column("key"), part.column("train"), part.column("place"), symbols, pa.array(sizes), *map(pa.array, sums)]
                doc_rows = pa.Table.from_arrays(columns, names=["key", "train", "place", "symbols", "n", "known", "base", "lm"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, doc_rows.schema) as w:
                    w.write_table(doc_rows)
                spread = (slice_id + (slice_id >> 32) * 40_503) % buckets  # documents go by any bucket, each slice's by another
                yield pack(slice_id, spread, keys=np.frombuffer(sink.getvalue(), np.uint8), docs=None, names=None, counts=None)
                if rare.any():
                    names = _VOCABULARY.names[tokens[rare]]
                    yield from by_bucket((names // np.uint64(FORMS)) % np.uint64(buckets), buckets, slice_id, {"keys": None}, docs=text[rare].astype("<u2"), names=names, counts=np.zeros((len(names), 0), np.uint8))

    return docs.select("key", "train", "place", "text").mapInArrow(send, "bucket int, slice long, keys binary, docs binary, names binary, counts binary")


def score(prepared: DataFrame, stats: Statistics, counted: DataFrame, model: Model, key: str, kind: str) -> DataFrame:
    """(key, n_tokens, n_known, base, lm) for prepared rows: base is the sum of log10(c + 0.5), lm the model's log10."""
    told = prepared.sparkSession.sparkContext.broadcast((stats.weights, model.members, model.vector()))

    def answer(batches):
        import numpy as np

        for _, rows in runs(batches, "bucket", ["slice", "keys", "docs", "names", "counts"]):
            known = next(((np.frombuffer(n, "<u8"), np.frombuffer(c, "<i8")) for s, _, _, n, c in rows if s < 0), None)
            for slice_id, keys, docs, names, _ in rows:
                if keys is not None:
                    yield _sums(slice_id, keys, None)
                elif slice_id >= 0:
                    names, docs = np.frombuffer(names, "<u8"), np.frombuffer(docs, "<u2")
                    c = np.zeros(len(names), dtype=np.int64)
                    if known is not None:
                        at = np.minimum(np.searchsorted(known[0], names), len(known[0]) - 1)
                        c = np.where(known[0][at] == names, known[1][at], 0)
                    own, back = np.unique(docs, return_inverse=True)
                    out = np.empty(len(own), dtype=[("doc", "<u2"), ("known", "<u4"), ("log", "<f8")])
                    out["doc"], out["known"], out["log"] = own, np.bincount(back, c > 0), np.bincount(back, np.log10(c + 0.5))
                    yield _sums(slice_id, None, out.tobytes())

    def _sums(slice_id, keys, sums):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([slice_id], pa.int64()), pa.array([keys], pa.binary()), pa.array([sums], pa.binary())], names=["slice", "keys", "sums"])

    def collect(batches):
        import numpy as np
        import pyarrow as pa

        weights, members, vector = told.value
        model = Model(weights, members).load(vector)
        for _, rows in runs(batches, "slice", ["keys", "sums"]):
            docs = pa.ipc.open_stream(next(k for k, _ in rows if k is not None)).read_all()
            n, known, base, lm = (docs.column(x).to_numpy().copy() for x in ("n", "known", "base", "lm"))
            symbols = np.frombuffer(b"".join(docs.column("symbols").to_pylist()), "<u2")
            own = model.log_probabilities(contexts(symbols, n, len(weights)), symbols)
            lm += np.bincount(np.repeat(np.arange(len(n)), n), own, len(n)) / math.log(10)
            told_ = sorted(s for k, s in rows if k is None)  # one order of adding, whatever order rows come in
            if told_:
                got = np.frombuffer(b"".join(told_), dtype=[("doc", "<u2"), ("known", "<u4"), ("log", "<f8")])
                known += np.bincount(got["doc"], got["known"], len(n))
                more = np.bincount(got["doc"], got["log"], len(n))
                base, lm = base + more, lm + more
            yield from pa.Table.from_arrays([docs.column("key"), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(lm)], names=["key", "n_tokens", "n_known", "base", "lm"]).to_batches()

    empty = F.lit(None).cast("binary")
    both = prepared.unionAll(counted.select("bucket", F.lit(-1).cast("long").alias("slice"), empty.alias("keys"), empty.alias("docs"), "names", "counts"))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "slice")
    back = dealt.mapInArrow(answer, "slice long, keys binary, sums binary").repartition("slice").sortWithinPartitions("slice")
    return back.mapInArrow(collect, f"key {kind}, n_tokens long, n_known long, base double, lm double").withColumnRenamed("key", key)


def language_model_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    buckets = bucket_count(docs)
    counted = scratch.keep(count_tokens(rows.where(fold("doc_id") != 1), buckets), "counts")
    stats = Statistics(counted)
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("place")
    prepared = prepare(rows.select(F.col("doc_id").alias("key"), (fold("doc_id") != 1).alias("train"), place, "text"), stats, buckets)
    prepared = scratch.keep(prepared, "prepared")
    model = train(prepared, stats)
    scored = score(prepared, stats, counted, model, "doc_id", rows.schema["doc_id"].dataType.simpleString())
    share_of_all = math.log10(stats.total + 0.5 * (stats.kinds + 1))
    return scored.select(
        F.col("doc_id").alias(key), (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(stats.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * share_of_all).alias("base_score"), F.col("lm").alias("score"),
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
