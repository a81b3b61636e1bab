"""BM25 over any number of fields: inverted index and scores of many questions at once (B1, B2)."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as X
from lodeseek.operators.nearest import BLOCK_BYTES, HELD, Best
from lodeseek.session import materialise, ship_package, spread

K1 = 1.4
B = 0.72


#: Terms that are broadcast at most.
BROADCAST_TERMS = 200_000
#: Binary places of a score's fixed-point sum.
PLACES = 40


@dataclass
class Index:
    """postings (field, term, ordinal, tf, len), terms (field, term, df, idf), totals (field, n, avg)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame

    def cache(self) -> "Index":
        for df in (self.postings, self.terms, self.totals):
            df.cache()
        return self


def build_index(docs: DataFrame, fields: dict[str, Column], ordinal: str = "ordinal", keep: bool = True, only: DataFrame | None = None) -> Index:
    """Indexes the fields of docs; of all terms, or of those in only (term) for a stated set of questions.

    Texts are tokenized once: a row without term stands for each document and field, also an empty one.
    Postings are written to the shared folder if keep. They carry the length of their document, so that
    scoring needs no further join.
    """
    # Only what is indexed moves, and only if it would be tokenized by a few tasks.
    docs = docs.select(F.col(ordinal).alias("ordinal"), *[t.alias(f"text_{f}") for f, t in fields.items()])
    fields, docs = {f: F.col(f"text_{f}") for f in fields}, spread(docs) if keep else docs
    rows = docs.select(
        "ordinal", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), X.tokenize(t).alias("tokens")) for f, t in fields.items()])).alias("x")
    ).select("ordinal", "x.field", "x.tokens")
    words = rows.select(
        "field", "ordinal", F.size("tokens").cast("long").alias("len"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("t")
    ).select("field", "ordinal", "len", X.stem(F.col("t")).alias("term"))
    if only is not None:
        known = only.select("term", F.lit(True).alias("known"))
        words = words.join(F.broadcast(known) if only.count() <= BROADCAST_TERMS else known, "term", "left").where("known OR term IS NULL").drop("known")
    every = words.groupBy("field", "term", "ordinal", "len").agg(F.count(F.lit(1)).alias("tf"))
    every = materialise(every, "postings") if keep else every
    postings = every.where("term IS NOT NULL")
    totals = every.where("term IS NULL").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    if keep:
        totals = materialise(totals, "totals")
    terms = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # A row for each field: bounded by the number of fields, which the caller writes down.
    terms = terms.join(F.broadcast(totals), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Index(postings, terms.select("field", "term", "df", idf.alias("idf")), totals)


def question_words(questions: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """qid, term, times: stems of tokens and joins, repeats counted, and acronyms that the question lacks.

    Tokens that the questions have already, as a column of that name, are taken as they are.
    """
    tokens = F.col("tokens") if "tokens" in questions.columns else X.tokenize(F.col(question))
    base = questions.select(F.col(qid).alias("qid"), tokens.alias("tokens"))
    stems = F.transform(X.expand_joins(F.col("tokens")), X.stem)
    base = base.select("qid", F.concat(stems, F.array_except(X.acronyms(F.col("tokens")), stems)).alias("words"))
    return base.select("qid", F.explode("words").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def query_terms(questions: DataFrame, index: Index, qid: str = "qid", question: str = "question", words: DataFrame | None = None) -> DataFrame:
    """qid, field, term, idf, times of the words that the field knows; words are those of the questions, if they are there already."""
    words = question_words(questions, qid, question) if words is None else words
    return words.join(index.terms.select("field", "term", "idf"), "term")


def bm25_scores(questions: DataFrame, index: Index, qid: str = "qid", question: str = "question") -> DataFrame:
    """qid, field, ordinal, score for each object that has a term of a question.

    Contributions are summed as integers of PLACES binary places: the sum is the same in any order, and is
    made partly before the shuffle.
    """
    terms = query_terms(questions, index, qid, question)
    hits = terms.join(index.postings, ["field", "term"]).join(F.broadcast(index.totals), "field")
    avg = F.when(F.col("avg") == 0, 1.0).otherwise(F.col("avg"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    fixed = F.round(part * float(1 << PLACES), 0).cast("long")
    return hits.groupBy("qid", "field", "ordinal").agg((F.sum(fixed) / F.lit(float(1 << PLACES))).alias("score"))


def bm25_top(questions: DataFrame, index: Index, k: int, qid: str = "qid", question: str = "question", places: int = 9, block_bytes: int = BLOCK_BYTES, words: DataFrame | None = None) -> DataFrame:
    """qid, field, ordinal, score, rank of the k best of each question and field, ties by ordinal: as top_k of bm25_scores.

    Weights of a block of questions are a matrix of terms and questions. Postings of these terms are dealt by
    document, and a task keeps k documents of each question, so that no row is made for a posting and question.
    Scores are rounded to `places` before they are ranked.
    """
    spark = questions.sparkSession
    ship_package(spark)
    terms = materialise(query_terms(questions, index, qid, question, words), "terms")
    kinds = {c: t.simpleString() for c, t in (("qid", terms.schema["qid"].dataType), ("ordinal", index.postings.schema["ordinal"].dataType))}
    # Most of what a block can need: its questions times its terms.
    asked, words = terms.agg(F.countDistinct("qid"), F.countDistinct("field", "term")).first()
    blocks = max(1, -(-asked * words * 8 // block_bytes))
    averages = {r["field"]: r["avg"] or 1.0 for r in index.totals.collect()}
    schema = f"field string, qid {kinds['qid']}, ordinal {kinds['ordinal']}, score double"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        block = _Weights(own.toArrow())
        if not block.words:
            continue
        numbers = spark.createDataFrame([(f, t, n) for (f, t), n in block.words.items()], "field string, term string, number int")
        small = len(block.words) <= BROADCAST_TERMS
        hits = index.postings.join(F.broadcast(numbers) if small else numbers, ["field", "term"]).select("field", "ordinal", "number", "tf", "len")
        hits = hits.repartition("field", "ordinal").sortWithinPartitions("field", "ordinal")
        out = out.unionByName(hits.mapInArrow(_best_of(spark.sparkContext.broadcast(block), averages, k, places), schema))
    return top_k(out, k, ("qid", "field"))


class _Weights:
    """The words of a block of questions, and times * idf of each word and question."""

    def __init__(self, terms: pa.Table):
        self.kind = terms.schema.field("qid").type
        rows = list(zip(*(terms.column(c).to_pylist() for c in ("qid", "field", "term", "times", "idf")), strict=True))
        self.asked = sorted({r[0] for r in rows})
        self.words = {x: n for n, x in enumerate(sorted({(r[1], r[2]) for r in rows}))}
        place = {q: n for n, q in enumerate(self.asked)}
        self.matrix = np.zeros((len(self.words), len(self.asked)))
        for q, field, term, times, idf in rows:
            self.matrix[self.words[field, term], place[q]] = times * idf


def _best_of(shared, averages: dict[str, float], k: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, kind, held = shared.value, {}, None, None
        step = max(1, HELD // max(1, len(block.asked)))

        def add(table: pa.Table) -> None:
            """Scores of whole documents: their postings stand together."""
            field, ordinals = table.column(0).to_numpy(zero_copy_only=False), table.column(1)
            names = ordinals.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (field[1:] != field[:-1]))))
            tf, length = (table.column(c).to_numpy().astype(np.float64)[:, None] for c in (3, 4))
            avg = np.array([averages[f] for f in field])[:, None]
            part = block.matrix[table.column(2).to_numpy()] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))
            score = np.add.reduceat(np.rint(part * float(1 << PLACES)).astype(np.int64), begins, axis=0) / float(1 << PLACES)
            d = np.where(score > 0, -np.round(score, places), np.inf).T
            keys = [ordinals[int(i)].as_py() for i in begins]
            for f in dict.fromkeys(field[begins]):
                own = np.flatnonzero(field[begins] == f)
                kept.setdefault(f, Best(len(block.asked), k)).add([keys[i] for i in own], d[:, own])

        for batch in batches:
            kind = batch.column(1).type
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows > step:
                # Up to the beginning of the last document: the rest of it may be in the next batch.
                last = (held.column(0)[-1].as_py(), held.column(1)[-1].as_py())
                names, fields = held.column(1).to_pylist(), held.column(0).to_pylist()
                cut = next((i for i in range(len(names), 0, -1) if (fields[i - 1], names[i - 1]) != last), 0)
                if not cut:
                    break
                for a, b in _spans(fields[:cut], names[:cut], step):
                    add(held.slice(a, b - a).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            add(held.combine_chunks())
        for f, best in kept.items():
            numbers, keys, found = best.columns()
            arrays = [pa.array([f] * len(keys), pa.string()), pa.array([block.asked[q] for q in numbers], block.kind), pa.array(keys, kind), pa.array([-x for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["field", "qid", "ordinal", "score"])

    return run


def _spans(fields: list, names: list, step: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about step rows."""
    begin = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or (i - begin >= step and (names[i], fields[i]) != (names[i - 1], fields[i - 1])):
            yield begin, i
            begin = i


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first k of each group by score, ties by ordinal."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc("score"), "ordinal")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
