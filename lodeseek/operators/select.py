"""The catalog and its selection: which objects answer a question, for a caller.

Scores of all questions are one lazy plan; the ranking of a question, at most one row for each object, is
collected once, and the steps that depend on one another (pins, reranking, coverage, expansion) run on it
and on what has been collected once for the index.
"""

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeseek import model as M
from lodeseek.functions import text as X
from lodeseek.functions.vectors import HashingEmbedder
from lodeseek.operators import fusion, graph, lexical
from lodeseek.operators.access import visible_objects
from lodeseek.operators.nearest import all_distances
from lodeseek.operators.render import estimate, may_see, qname_of, render_ddl
from lodeseek.operators.serving import ServedIndex
from lodeseek.session import materialise

#: Fixed values of coverage.
COVER_IDF = 2.0
COVER_MOST = 3
STOP_WORDS = frozenset("of by as at in on to for and or per the a an is are was".split())


@dataclass
class Hit:
    row: Row
    score: float
    reason: str


class Selection:
    """What was selected for a question and a caller."""

    def __init__(self, question: str, hits: list[Hit], objects: list[Row], principal=None, max_columns: int = 40):
        self.question, self.hits, self.principal, self.max_columns = question, hits, principal, max_columns
        self.total_objects = len(objects)
        self._objects = objects
        seen = {r["name"].lower() for r in objects if may_see(r["roles"], principal)}
        self.hidden = frozenset(r["name"].lower() for r in objects) - seen

    def table_names(self) -> list[str]:
        return [qname_of(h.row) for h in self.hits]

    def prompt_fragment(self) -> str:
        return "\n\n".join(render_ddl(h.row, self.principal, self.max_columns, self.hidden) for h in self.hits)

    def object_list(self) -> str:
        return "\n".join(f"{h.row['kind']} {qname_of(h.row)}" for h in self.hits)

    def explain(self) -> str:
        return "\n".join(f"{qname_of(h.row)}  {h.score:.4f}  {h.reason}" for h in self.hits)

    def to_dict(self) -> dict:
        """The audit record (P4): counts of columns shown and withheld, never their names."""
        count = lambda r: sum(may_see(c["roles"], self.principal) for c in r["columns"])
        return {
            "question": self.question,
            "subject": self.principal.subject if self.principal else None,
            "roles": sorted(self.principal.roles) if self.principal else [],
            "total_objects": self.total_objects,
            "objects": [
                {"object": qname_of(h.row), "score": h.score, "reason": h.reason, "columns_shown": count(h.row), "columns_withheld": len(h.row["columns"]) - count(h.row)}
                for h in self.hits
            ],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    def savings(self) -> float:
        """1 - the tokens of the selection over those of all that the caller may see."""
        full = sum(estimate(render_ddl(r, self.principal, self.max_columns, self.hidden)) for r in self._objects if may_see(r["roles"], self.principal))
        return 1 - estimate(self.prompt_fragment()) / full if full else 0.0


def expand_glossary(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """questions with the meanings of the glossary terms they contain appended (S0). glossary: term, meaning.

    Terms are looked up by runs of words of a question, as written and with spaces removed, so the join is
    on equal keys; a run is as long as the longest term.
    """
    terms = glossary.select("term", "meaning", F.lower(F.regexp_replace("term", r"\s+", "")).alias("key"), F.size(F.split("term", r"\s+")).alias("words"))
    most = terms.agg(F.max("words")).first()[0] or 0
    if not most:
        return questions
    words = F.filter(F.split(F.lower("question"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = questions.select("qid", words.alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), ""))))
    keys = rows.where(F.size("w") > 0).select("qid", F.explode(F.array_distinct(runs)).alias("key"))
    found = keys.join(terms, "key").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("term", "meaning"))), lambda x: x["meaning"]), " ").alias("more"))
    return questions.join(found, "qid", "left").withColumn("question", F.concat_ws(" ", "question", "more")).drop("more")


class Catalog:
    """Objects, their indexes and what may be asked of them.

    Edits change a list on the driver (a catalog is a row for each table, not data); the next question
    builds the indexes anew if an edit has made them stale. Roles are looked at when a question is asked.
    """

    def __init__(self, spark: SparkSession, embedder=None, name: str = "catalog"):
        self.spark, self.embedder, self.name = spark, embedder or HashingEmbedder(), name
        self._rows: dict[str, dict] = {}
        self._stale, self._index = True, None
        # The objects with the roles that were last looked at, and what a single selection needs on the driver.
        self._seen, self._held = None, None

    # Edits (P5)

    def add(self, row: dict) -> "Catalog":
        self._rows[qname_of(row)] = row
        self._stale = True
        return self

    def add_all(self, rows) -> "Catalog":
        for r in rows.collect() if isinstance(rows, DataFrame) else rows:
            self.add(r.asDict(recursive=True) if isinstance(r, Row) else r)
        return self

    def __len__(self) -> int:
        return len(self._rows)

    def find(self, name: str) -> dict:
        """The first object of this qname or bare name."""
        if name in self._rows:
            return self._rows[name]
        for r in self._rows.values():
            if r["name"].lower() == name.lower():
                return r
        raise KeyError(name)

    def restrict(self, name: str, roles) -> None:
        self.find(name)["roles"] = sorted(roles)

    def restrict_column(self, name: str, column: str, roles) -> None:
        """Also forgets sampled values of the column."""
        row = self.find(name)
        for k, c in enumerate(row["columns"]):
            if c["name"].lower() == column.lower():
                row["columns"][k] = dict(c) | {"roles": sorted(roles), "values": None}
                return
        raise KeyError(f"{name}.{column}")

    def hint(self, name: str, text: str) -> None:
        self.find(name)["hint"] = M.one_text(text)
        self._stale = True

    def describe(self, texts, only_missing: bool = True) -> int:
        """Descriptions from a mapping by qname or bare name, or from a callable over objects (M4)."""
        done = 0
        for q, r in self._rows.items():
            if only_missing and r["description"]:
                continue
            text = texts(r) if callable(texts) else texts.get(q, texts.get(r["name"]))
            if text:
                r["description"] = M.one_text(text)
                done += 1
        self._stale |= bool(done)
        return done

    def objects(self) -> DataFrame:
        rows = [{"ordinal": k, **r} for k, r in enumerate(self._rows.values())]
        names = [f.split()[0] for f in ("ordinal name schema kind description hint columns foreign_keys row_estimate definition roles extra").split()]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], M.OBJECTS)

    def infer_foreign_keys(self) -> int:
        before = self.objects()
        found = graph.with_inferred(before).orderBy("ordinal").collect()
        added = 0
        for r, own in zip(found, self._rows.values(), strict=True):
            added += len(r["foreign_keys"]) - len(own["foreign_keys"])
            own["foreign_keys"] = [k.asDict() for k in r["foreign_keys"]]
        self._stale |= bool(added)
        return added

    def restrict_from_grants(self, grants: DataFrame, roles: DataFrame | None = None, public_grantees=("PUBLIC",)):
        from lodeseek.operators.access import apply_grants

        out, report = apply_grants(self.objects(), grants, roles, tuple(public_grantees))
        for r, own in zip(out.orderBy("ordinal").collect(), self._rows.values(), strict=True):
            own["roles"] = r["roles"]
        return report

    # Index (B3)

    def index(self) -> None:
        # Kept while the edits that follow don't make it stale.
        rows = M.with_fields(self.objects()).withColumn("name_tokens", X.tokenize(F.col("name"))).cache()
        vectors = self.embedder.embed_column(rows.select("ordinal", "body_text"), F.col("body_text")).select("ordinal", "vec").cache()
        built = lexical.build_index(rows, {f: F.col(f"{f}_text") for f in M.FIELDS}, keep=False).cache()
        self._index = (rows, vectors, built, graph.shadows(rows).cache(), graph.dimensions(rows).cache())
        self._seen, self._held = None, None
        self._stale = False

    def _indexed(self):
        if self._stale or self._index is None:
            self.index()
        # Roles may have changed since; a row for each object, as the catalog itself is on the driver.
        rows, vectors, built, copies, dims = self._index
        roles = [r["roles"] for r in self._rows.values()]
        if self._rows and (self._seen is None or self._seen[0] != roles):
            own = self.spark.createDataFrame(list(enumerate(roles)), "ordinal long, roles array<string>")
            self._seen = (roles, rows.drop("roles").join(F.broadcast(own), "ordinal").cache())
        return self._seen[1] if self._rows else rows, vectors, built, copies, dims

    def _kept(self) -> tuple[dict[int, Row], dict[int, set], dict[str, float], set[int], ServedIndex]:
        """Objects, tokens of their names, idf of these, dimensions and the index itself, collected once."""
        if self._held is None:
            rows, vectors, built, copies, dims = self._index
            named = rows.withColumn("name_words", X.tokenize(M.name_text())).collect()
            served = ServedIndex(rows, vectors, built, copies)
            idf = {term: x for (field, term), x in served.idf.items() if field == "name"}
            self._held = ({r["ordinal"]: r for r in named}, {r["ordinal"]: set(r["name_words"]) for r in named}, idf, {r["ordinal"] for r in dims.collect()}, served)
        return self._held

    def _by_ordinal(self) -> dict[int, Row]:
        """Objects by place, with the roles that they have now."""
        objects = self._kept()[0]
        names = next(iter(objects.values())).__fields__ if objects else []
        at = names.index("roles") if names else 0
        make = Row(*names)
        return {k: make(*(r["roles"] if i == at else v for i, v in enumerate(objects[k]))) for k, r in enumerate(self._rows.values())}

    def shadows(self) -> dict[str, str]:
        rows, _, _, copies, _ = self._indexed()
        return {r["qname"]: r["base"] for r in copies.join(rows, "ordinal").select("qname", "base").collect()}

    def dimensions(self) -> dict[str, int]:
        rows, _, _, _, dims = self._indexed()
        return {r["qname"]: r["in_degree"] for r in dims.join(rows, "ordinal").select("qname", "in_degree").collect()}

    # Selection

    def scores(self, questions: DataFrame, user_roles=None, vector_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
        """qid, ordinal, score, in_vector, in_body ..., place: the ranking of all questions (qid, question) in one plan."""
        rows, vectors, built, copies, _ = self._indexed()
        visible = visible_objects(rows, user_roles)
        # Tokenized once: the plans of all channels begin with the tokens.
        if "tokens" not in questions.columns:
            questions = materialise(questions.select("qid", "question", X.tokenize(F.col("question")).alias("tokens")), "questions")
        # Joins that the body field knows, by stem, are added to the question's tokens.
        joins = questions.select("qid", "tokens", F.posexplode_outer(F.array_except(X.expand_joins(F.col("tokens")), F.col("tokens"))).alias("p", "join"))
        known = built.terms.where("field = 'body'").select(F.col("term").alias("join"), F.lit(True).alias("known"))
        joins = joins.join(known, "join", "left").groupBy("qid").agg(
            F.first("tokens").alias("tokens"), F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("p", "join")))).alias("j")
        )
        full = joins.select("qid", F.concat("tokens", F.transform("j", lambda x: x["join"])).alias("tokens"))
        if hasattr(self.embedder, "embed_tokens"):
            asked = self.embedder.embed_tokens(full.select("qid", "tokens"), F.col("tokens"), "qvec").select("qid", "qvec")
        else:
            asked = self.embedder.embed_column(full, F.array_join("tokens", " "), "qvec").select("qid", "qvec")
        # A stated set of questions against all objects of the catalog, in blocks.
        free = F.lit(None).cast("string")
        near = all_distances(asked.withColumn("qscope", free), vectors.select(F.col("ordinal").alias("key"), "vec", free.alias("scope"))).withColumnRenamed("key", "ordinal")
        ranks = fusion.vector_ranks(near, visible).unionByName(fusion.lexical_ranks(lexical.bm25_scores(questions, built), visible))
        fused = fusion.fuse(ranks, {"vector": vector_weight, "body": lexical_weight})
        return fusion.ranked(fusion.adjust(fused, visible, copies, rows, questions))

    def select_many(self, questions: DataFrame, top_k: int = 6, user_roles=None) -> DataFrame:
        """qid, place, qname, score, reason of the first top_k objects of each question, without the sequential steps."""
        rows = self._indexed()[0]
        first = self.scores(questions, user_roles).where(F.col("place") <= top_k)
        return first.join(rows.select("ordinal", "qname"), "ordinal").select(
            "qid", "place", "qname", "score", fusion.reason(F.col("in_vector"), F.col("in_body")).alias("reason")
        )

    def select(
        self, question: str, top_k: int = 6, principal=None, expand_fks: bool = True, pin=None, vector_weight: float = 1.0, lexical_weight: float = 1.0,
        reranker: Callable[[str], str] | None = None, rerank_candidates: int = 20,
    ) -> Selection:
        self._indexed()
        roles = sorted(principal.roles) if principal else None
        tokens = X.words_of(question)
        by_ordinal = self._by_ordinal()
        seen = {k: r for k, r in by_ordinal.items() if may_see(r["roles"], principal)}
        ranking = self._ranking(question, tokens, roles, set(seen), {"vector": vector_weight, "body": lexical_weight})
        hits = self._pinned(pin, seen)
        taken = {h.row["ordinal"] for h in hits}
        rest = [r for r in ranking if r.ordinal not in taken]
        if reranker is not None:
            rest = rerank(question, rest, by_ordinal, reranker, top_k, rerank_candidates, principal)
        for r in rest[: max(0, top_k - len(hits))]:
            why = "hybrid" if r.in_vector and r.in_body else "vector" if r.in_vector else "lexical"
            hits.append(Hit(by_ordinal[r.ordinal], r.score, why))
        hits = self._covered(tokens, hits, [by_ordinal[r.ordinal] for r in ranking], top_k)
        if expand_fks:
            hits = self._expanded(hits, seen)
        return Selection(question, hits, list(by_ordinal.values()), principal)

    def _ranking(self, question: str, tokens: list[str], roles, seen: set[int], weights: dict[str, float]) -> list:
        """The ranking of one question: on the driver, or by the plan for many if vectors come from somewhere else."""
        if isinstance(self.embedder, HashingEmbedder):
            return self._kept()[4].rank(tokens, self.embedder.vector, seen, weights)
        asked = self.spark.createDataFrame([(0, question, tokens)], "qid long, question string, tokens array<string>")
        return self.scores(asked, roles, weights["vector"], weights["body"]).orderBy("place").collect()

    def _pinned(self, pin, seen: dict[int, Row]) -> list[Hit]:
        """All visible objects of each pinned qname or bare name, in the order of the pins."""
        hits, taken = [], set()
        for p in [pin] if isinstance(pin, str) else pin or []:
            for k, r in seen.items():
                if k not in taken and p.lower() in (r["qname"].lower(), r["name"].lower()):
                    taken.add(k)
                    hits.append(Hit(r, 1.0, "pinned"))
        return hits

    def _covered(self, tokens: list[str], hits: list[Hit], ranking: list[Row], top_k: int) -> list[Hit]:
        """Objects for words of the question that no chosen name has (S12): a dimension first, in place of the last hit if all places are taken."""
        found = [{"t": t, "s": X.stem_word(t)} for t in dict.fromkeys(X.with_joins(tokens))]
        _, names, idf, dims, _ = self._kept()
        chosen = {t for h in hits for t in names[h.row["ordinal"]]}
        # The index holds stems but is asked for the word as written, so most plurals never count.
        bare = [r for r in found if len(r["t"]) > 2 and r["t"] not in STOP_WORDS and idf.get(r["t"], 0.0) >= COVER_IDF and not {r["t"], r["s"]} & chosen]
        for r in bare[:COVER_MOST]:
            taken = {h.row["ordinal"] for h in hits}
            having = [x for x in ranking if x["ordinal"] not in taken and r["t"] in names[x["ordinal"]]]
            best = next((x for x in having if x["ordinal"] in dims), having[0] if having else None)
            if best is None:
                continue
            if len(hits) >= top_k:
                last = next((k for k in range(len(hits) - 1, -1, -1) if hits[k].reason not in ("pinned", "covers")), None)
                if last is None:
                    break
                hits.pop(last)
            hits.append(Hit(best, 0.0, "covers"))
        return hits

    def _expanded(self, hits: list[Hit], seen: dict[int, Row]) -> list[Hit]:
        """Visible objects that a hit references, one step, by bare name in any schema."""
        taken, more = {h.row["ordinal"] for h in hits}, []
        for h in hits:
            for k in h.row["foreign_keys"]:
                for o, r in seen.items():
                    if o not in taken and r["name"].lower() == (k["ref_table"] or "").lower():
                        taken.add(o)
                        more.append(Hit(r, 0.0, "fk"))
        return hits + more

    def select_widening(self, question: str, answer: Callable[[Selection], str], top_k: int | None = None, **options):
        """Asks once, and once more with more objects if the answer is a refusal, unless the caller gave top_k."""
        k = top_k or 6
        picked = self.select(question, top_k=k, **options)
        said = answer(picked)
        if said.strip().upper().startswith("INSUFFICIENT") and top_k is None and k < 10:
            picked = self.select(question, top_k=max(15, 2 * k), **options)
            return picked, answer(picked), "more objects than usual were needed"
        return picked, said, None


def rerank_prompt(question: str, rows: list[Row], principal=None, width: int = 150) -> str:
    """Numbered one-liners of the candidates, with the columns that the caller may see (M5)."""
    lines = []
    for k, r in enumerate(rows, 1):
        about = (r["hint"] or (r["description"] or "").split(" | ")[0] or ", ".join(c["name"] for c in r["columns"] if may_see(c["roles"], principal)))
        lines.append(f"{k}. {r['qname']}: {' '.join(about.split())}"[:width])
    return f"Question: {question}\n\n" + "\n".join(lines)


def rerank(question: str, rest: list[Row], by_ordinal: dict[int, Row], reranker, top_k: int, candidates: int, principal=None) -> list[Row]:
    """The chosen of the first candidates, the others of these, then the rest (S10); unchanged if the reranker fails or has no choice."""
    head, tail = rest[:candidates], rest[candidates:]
    if len(head) <= 1:
        return rest
    try:
        reply = reranker(rerank_prompt(question, [by_ordinal[r.ordinal] for r in head], principal))
        chosen = choose(reply, len(head), top_k)
    except Exception:  # noqa: BLE001  a model that fails leaves the order as it is
        return rest
    picked = [head[i - 1] for i in chosen]
    return picked + [r for k, r in enumerate(head, 1) if k not in chosen] + tail


def choose(reply: str, n: int, top_k: int) -> list[int]:
    """The driver's form of parse_choice."""
    import re

    seen = dict.fromkeys(int(x) for x in re.findall(r"(?<![\w.])\d+(?!\w)", reply or "") if 1 <= int(x) <= n)
    return list(seen)[:top_k]
