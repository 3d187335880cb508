"""A shift-reduce parser from tokens to terms, with a beam and log-linear scores.

Parsing a question is imperative work on a few tokens: it runs in Arrow batches of questions on the executors. Answering and
learning are done on tables of derivations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.kb.compiler import answer_plans
from graphloom.lang.parser import Context, parse, standard_context
from graphloom.lang.terms import App, Fn, Term, apply, entity, normalise, prop, show, typecheck
from graphloom.lang.types import BOOL, FAIL, Type, apply_type
from graphloom.parsing import vectors as V
from graphloom.session import cut

WH_TERM = "(lambda (P:e=>t) (@exists (x:e) (P x)))"
#: Derivations of a batch sent back, beside those of its last question.
SENT = 20_000
#: Derivations that a task keeps for questions of the same tokens.
KNOWN = 10_000
#: What is told of a derivation beside its question: types of Spark and Arrow, and what a question without a parse has.
COLUMNS = {
    "deriv": ("int", pa.int32(), -1),
    "score": ("double", pa.float64(), 0.0),
    "ltype": ("string", pa.string(), None),
    "term": ("string", pa.string(), None),
    "shape": ("string", pa.string(), None),
    "features": ("array<struct<x:array<string>,y:string,n:int>>", pa.list_(pa.struct([("x", pa.list_(pa.string())), ("y", pa.string()), ("n", pa.int32())])), []),
    "status": ("string", pa.string(), "no_parse"),
    "steps": ("array<string>", pa.list_(pa.string()), []),
    "display": ("string", pa.string(), None),
}


@dataclass(frozen=True)
class Token:
    form: str
    macro: str | None = None
    term: Term | None = None
    type: Type | None = None

    @property
    def tag(self) -> str:
        return self.macro if self.macro in ("AND", "OR") else "NOTAG"

    @property
    def is_property(self) -> bool:
        return bool(self.macro) and self.macro[0] == "P"


@dataclass(frozen=True)
class Action:
    """kind S shift, D drop, U shift with a unary combinator, > and < application, C coordination."""

    kind: str
    macro: str | None = None
    combinator: Term | None = None
    type: Type | None = None

    @property
    def label(self) -> str:
        return f"{self.kind}[{self.macro}]" if self.macro else self.kind

    def result(self, left: Type | None, right: Type | None = None) -> Type:
        if self.kind == "U":
            return apply_type(self.type, left)
        fn, arg = (right, left) if self.kind == "<" else (left, right)
        return apply_type(apply_type(self.type, fn) if self.combinator else fn, arg)

    def build(self, left: Term, right: Term | None = None) -> Term:
        if self.kind == "U":
            return App(self.combinator, left)
        fn, arg = (right, left) if self.kind == "<" else (left, right)
        return apply(self.combinator, fn, arg) if self.combinator else App(fn, arg)


def actions(context: Context | None = None) -> list[Action]:
    """The ten actions in their fixed order. Shifting without a combinator name takes a token as it is; a bare U,
    which has nothing to apply, gives the failure type."""
    terms = (context or standard_context()).terms

    def named(kind: str, name: str) -> Action:
        return Action(kind, name, terms[name], typecheck(terms[name]))

    return [Action("S"), Action(">"), Action("<"), Action("D"), Action("U"), named("U", "SWAP"), named(">", "JOIN"), named("<", "JOIN"), named("C", "AND"), named("C", "OR")]


@dataclass(frozen=True)
class Item:
    label: str
    head: int
    type: Type | None
    term: Term | None


@dataclass(frozen=True)
class State:
    stack: tuple[Item, ...] = ()
    at: int = 0
    score: float = 1.0
    last: str | None = None
    features: tuple[tuple[tuple[str, ...], str], ...] = ()
    steps: tuple[str, ...] = ()


class Machine:
    """Transitions over one question."""

    def __init__(self, weights: dict[tuple[tuple[str, ...], str], float] | None = None, acts: list[Action] | None = None) -> None:
        self.weights = weights or {}
        self.acts = acts or actions()

    def legal(self, s: State, tokens: list[Token], a: Action) -> bool:
        if a.kind in "SDU":
            if s.at >= len(tokens):
                return False
            if a.kind == "D":
                return s.last not in (">", "<")
            token = tokens[s.at]
            return token.term is not None and (a.kind == "S" or token.is_property)
        if a.kind == "C":
            return len(s.stack) >= 3 and s.stack[-2].label == a.macro and a.result(s.stack[-3].type, s.stack[-1].type) != FAIL
        return len(s.stack) >= 2 and a.result(s.stack[-2].type, s.stack[-1].type) != FAIL

    def features(self, s: State, tokens: list[Token]) -> list[tuple[str, ...]]:
        """Labels and forms at the bottom of the stack, forms ahead."""
        bottom = s.stack[:2]
        if not bottom:
            out: list[tuple[str, ...]] = [("S", "#START#")]
        else:
            pad = ["#START#"] * (2 - len(bottom))
            out = [("S", *(i.label for i in bottom), *pad), ("S", *(tokens[i.head].form for i in bottom), *pad)]
        ahead = [t.form for t in tokens[s.at : s.at + 2]]
        out.append(("B", *ahead, *(["#END#"] if len(ahead) < 2 else [])))
        return out

    def follow(self, s: State, tokens: list[Token], a: Action, score: float, x: list[tuple[str, ...]]) -> State:
        stack, at = s.stack, s.at
        if a.kind == "D":
            at += 1
        elif a.kind in "SU":
            t = tokens[at]
            if a.kind == "S":
                item = Item(t.tag, at, t.type, t.term)
            else:
                item = Item(t.tag, at, a.result(t.type) if a.combinator else FAIL, a.build(t.term) if a.combinator else t.term)
            stack, at = (*stack, item), at + 1
        elif a.kind == "C":
            left, middle, right = stack[-3:]
            stack = (*stack[:-3], Item(a.label, middle.head, a.result(left.type, right.type), a.build(left.term, right.term)))
        else:
            left, right = stack[-2:]
            head = left.head if a.kind == ">" else right.head
            stack = (*stack[:-2], Item(a.label, head, a.result(left.type, right.type), a.build(left.term, right.term)))
        return State(stack, at, score, a.kind, s.features + tuple((f, a.label) for f in x), (*s.steps, a.label))

    def replay(self, tokens: list[Token], steps: list[str]) -> tuple[State, str]:
        """The derivation that the labels of its actions name, again from the start, and its display tree: a leaf for each token
        that was shifted, a node for each combination."""
        by_label = {a.label: a for a in self.acts}
        s, shown = State(), []
        for label in steps:
            a = by_label[label]
            if not self.legal(s, tokens, a):
                raise ValueError(f"{label} isn't possible after {' '.join(s.steps)}")
            if a.kind in "SU":
                shown.append(f"({label} {tokens[s.at].form})")
            elif a.kind == "C":
                shown[-3:] = [f"({label} {' '.join(shown[-3:])})"]
            elif a.kind != "D":
                shown[-2:] = [f"({label} {' '.join(shown[-2:])})"]
            s = self.follow(s, tokens, a, s.score, self.features(s, tokens))
        return s, " ".join(shown)

    def parse(self, tokens: list[Token], width: int) -> list[State]:
        """Complete derivations, best first: all tokens read, one item left. They leave the beam and don't count against it."""
        beam, done = [State()], []
        while beam:
            options = []
            for s in beam:
                x = self.features(s, tokens)
                for a in self.acts:
                    if self.legal(s, tokens, a):
                        options.append((s.score * math.exp(sum(self.weights.get((f, a.label), 0.0) for f in x)), s, a, x))
            options.sort(key=lambda o: o[0], reverse=True)
            beam = []
            for score, s, a, x in options[:width]:
                new = self.follow(s, tokens, a, score, x)
                (done if new.at == len(tokens) and len(new.stack) == 1 else beam).append(new)
        return sorted(done, key=lambda s: s.score, reverse=True)

    def described(self, tokens: list[Token], width: int, wanted: Sequence[str]) -> list[tuple]:
        """A row of the wanted COLUMNS for each complete derivation, best first; one if there is none."""
        out = []
        for i, s in enumerate(self.parse(tokens, width)):
            told: dict = {"deriv": i, "score": s.score, "ltype": s.stack[0].type if isinstance(s.stack[0].type, str) else "function", "status": "ok", "steps": list(s.steps)}
            term = normalise(s.stack[0].term) if "term" in wanted or "shape" in wanted else None
            if "term" in wanted:
                told["term"] = show(term)
            if "shape" in wanted:
                told["shape"] = shape(term)
            if "features" in wanted:
                told["features"] = [{"x": list(x), "y": y, "n": n} for (x, y), n in Counter(s.features).items()]
            if "display" in wanted:
                told["display"] = self.replay(tokens, told["steps"])[1]
            out.append(tuple(told[c] for c in wanted))
        return out or [tuple(COLUMNS[c][2] for c in wanted)]


def token(form: str, macro: str | None, wh: Term) -> Token:
    if not macro:
        return Token(form)
    if macro in ("AND", "OR"):
        # a coordinator is shifted to stand between its sides; its own type never applies
        return Token(form, macro, Fn(macro, FAIL), FAIL)
    term = wh if macro == "WHQ" else entity(macro) if macro[0] == "Q" else prop(macro)
    return Token(form, macro, term, typecheck(term))


def shape(term: Term) -> str:
    """The term with its ids replaced by numbers: derivations of one shape are answered by one plan."""
    ids: dict[str, str] = {}
    out = []
    for word in show(term).replace("(", " ( ").replace(")", " ) ").split():
        if word.startswith(("wd:", "wdt:")):
            word = word.split(":")[0] + ":" + ids.setdefault(word, f"#{len(ids)}")
        out.append(word)
    return " ".join(out)


class QuestionParser:
    """Questions, as rows (qid, pos, form, macro) of linked tokens, to derivations."""

    def __init__(self, weights: dict[tuple[tuple[str, ...], str], float] | None = None, width: int = 500) -> None:
        self.weights = weights or {}
        self.width = width

    def derivations(self, tokens: DataFrame, columns: Sequence[str] = tuple(COLUMNS)) -> DataFrame:
        """(qid, deriv, score, ltype, term, shape, features, status, steps, display): all complete derivations with their actions and
        the tree that shows them; status no_parse rows have deriv -1. Of `columns`, only those are made.

        A question's tokens are gathered to a row; a question is a sentence, not a corpus. Questions of the same tokens have the
        same derivations, which a task makes once and sends for each of them. The number of tasks is given, as questions
        are few bytes for the work they make.
        """
        tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        questions = tokens.repartition(tasks, "qid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "form", "macro"))).alias("toks"))
        held = tokens.sparkSession.sparkContext.broadcast(self.weights)  # as many as features of the training questions
        width, wanted = self.width, list(columns)
        schema = ", ".join(["qid long", *(f"{c} {COLUMNS[c][0]}" for c in wanted)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, wh = Machine(held.value), parse(WH_TERM)
            known: dict[tuple, list[tuple]] = {}
            n_known = 0
            for b in batches:
                qids, own, at, places = [], [], [], {}

                def rows() -> pa.RecordBatch:
                    cols = list(zip(*own)) or [[] for _ in wanted]
                    made = [pa.array(list(c), COLUMNS[name][1]).take(pa.array(at, pa.int32())) for c, name in zip(cols, wanted)]
                    return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), *made], names=["qid", *wanted])

                for qid, toks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    question = tuple((t["form"], t["macro"]) for t in toks)
                    if question not in places:
                        if question not in known:
                            known[question] = machine.described([token(form, macro, wh) for form, macro in question], width, wanted)
                            n_known += len(known[question])
                        places[question] = range(len(own), len(own) + len(known[question]))
                        own.extend(known[question])
                        while n_known > KNOWN:  # the oldest
                            n_known -= len(known.pop(next(iter(known))))
                    at.extend(places[question])
                    qids.extend([qid] * len(places[question]))
                    if len(at) >= SENT:
                        yield rows()
                        qids, own, at, places = [], [], [], {}
                yield rows()

        return questions.select(F.col("qid").cast("long").alias("qid"), "toks").mapInArrow(run, schema)

    def predict(self, tokens: DataFrame) -> DataFrame:
        """Each question's most probable derivation of type t: (qid, term, p)."""
        good = V.probabilities(self.derivations(tokens).filter("status = 'ok'")).filter(F.col("ltype") == BOOL)
        return V.best(good.select("qid", "deriv", "term", "shape", "p"))

    def fit(self, tokens: DataFrame, answers: Callable[[DataFrame], DataFrame], gold: DataFrame, epochs: int = 5, rate: float = 1.0) -> list[float]:
        """Gradient steps on all questions at once, a mini-batch of the whole set where the sequential rule would take one
        question at a time. answers gives (qid, deriv, answer) for derivations; gold has (qid, answer). Weights
        start anew. Returns the log-likelihood after each epoch; the questions that have no parse are left out."""
        self.weights, history = {}, []
        for _ in range(epochs):
            d = cut(V.probabilities(self.derivations(tokens).filter("status = 'ok'")))
            right = answers(d.filter(F.col("ltype") == BOOL)).join(gold.select("qid", "answer"), ["qid", "answer"], "left_semi").select("qid", "deriv").distinct().withColumn("ok", F.lit(True))
            d = cut(d.join(right, ["qid", "deriv"], "left").withColumn("correct", F.coalesce("ok", F.lit(False))))
            features = d.select("qid", "deriv", F.explode("features").alias("f")).select("qid", "deriv", "f.*")
            for r in V.gradient(d, features).collect():  # one row a feature of the training questions
                key = (tuple(r["x"]), r["y"])
                self.weights[key] = self.weights.get(key, 0.0) + rate * r["w"]
            history.append(V.log_likelihood(d).first()[0])
        return history

    def evaluate(self, tokens: DataFrame, answers: Callable[[DataFrame], DataFrame], gold: DataFrame) -> DataFrame:
        """(n_questions, n_correct, accuracy): questions whose best derivation of type t gives an answer of gold (qid, answer), among
        all questions of `tokens`, those without a parse being wrong."""
        best = cut(self.predict(tokens))
        right = answers(best)
        asked = tokens.select("qid").distinct()
        if right is not None:
            good = right.join(gold.select("qid", "answer"), ["qid", "answer"], "left_semi").select("qid").distinct().withColumn("good", F.lit(1))
            asked = asked.join(good, "qid", "left")
        else:
            asked = asked.withColumn("good", F.lit(None).cast("int"))
        return asked.agg(F.count("*").alias("n_questions"), F.count("good").alias("n_correct")).withColumn("accuracy", F.coalesce(F.try_divide("n_correct", "n_questions"), F.lit(0.0)))

    def train_and_test(self, train: DataFrame, test: DataFrame, answers: Callable[[DataFrame], DataFrame], gold: DataFrame, epochs: int = 5, rate: float = 1.0) -> dict:
        """Weights from one set of questions, accuracy on both: {'log_likelihood': one an epoch, 'train': accuracy, 'test': accuracy}."""
        history = self.fit(train, answers, gold, epochs, rate)
        return {"log_likelihood": history, **{name: self.evaluate(q, answers, gold).first()["accuracy"] for name, q in (("train", train), ("test", test))}}

    def weights_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(list(x), y, float(w)) for (x, y), w in self.weights.items()], "x array<string>, y string, w double")


def answers_by_shape(derivations: DataFrame, kb, most_shapes: int = 64) -> DataFrame | None:
    """(qid, deriv, answer) of derivations of type t with one answer variable: one compiled plan a shape, its ids being columns
    that are joined. Shapes come from the grammar, not from the data; more than most_shapes of them raise. None for no shape."""
    shapes = derivations.groupBy("shape").agg(F.min("term").alias("term")).limit(most_shapes + 1).collect()
    if len(shapes) > most_shapes:
        raise ValueError("more shapes than plans")
    out = None
    for r in shapes:
        ids = list(dict.fromkeys(re.findall(r"wdt?:([A-Z]\d+)", r["term"])))
        own = derivations.filter(F.col("shape") == r["shape"])
        found = F.array_distinct(F.regexp_extract_all("term", F.lit(r"wdt?:([A-Z]\d+)"), 1))
        plans = own.select("qid", "deriv", *(F.get(found, F.lit(i)).alias(f"__id{i}") for i in range(len(ids))))
        part = answer_plans(kb.term(r["term"]), kb.triples, plans, ["qid", "deriv"], {x: f"__id{i}" for i, x in enumerate(ids)})
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out
