"""Datalog over quads: parser, stratification, semi-naive evaluation, and what is built on it.

Rules read ``?x :p ?z :- ?x :p ?y, ?y :p ?z, NOT ?x :q ?z, ?n > 5, ?m IS ?n + 1, COUNT(?y WHERE ?x :p ?y) = ?n .`` with
``@weight(0.8)`` and ``@name("r")``; an empty head is a constraint. Facts are a DataFrame (s, p, o, g) with term structs.
Each round joins one body atom with the facts of the last round only, and keeps what is new (anti-join); rounds are written
to the shared folder.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import TERM, Val
from ..plans import algebra as A
from ..plans.compiler import Compiler, Context, Solutions
from ..plans.parser import Parser, SparqlError
from .graph import components
from .lineage import dealt, in_rounds, written

TRIPLE = ["s", "p", "o"]
MAX_ROUNDS = 10_000


#: Rules made of axioms are made on the driver; more are an error.
MOST_AXIOMS = 100_000


class DatalogError(ValueError):
    """The rules can't be parsed or stratified."""


@dataclass(frozen=True)
class Aggregate:
    fn: str
    var: str
    atom: A.Triple
    result: str


@dataclass(frozen=True)
class Rule:
    head: A.Triple | None
    body: tuple  # Triples
    negated: tuple = ()
    guards: tuple = ()  # expressions
    assigns: tuple = ()  # (var, expression)
    aggregates: tuple = ()
    weight: float = 1.0
    name: str = ""

    @property
    def text(self) -> str:
        return self.name or f"{self.head} :- {self.body}"


class _Rules(Parser):
    def rules(self) -> list[Rule]:
        out = []
        while True:
            self.prologue()
            if self.kind == "end":
                return out
            out.append(self.rule())

    def atom(self) -> A.Triple:
        s = self.term()
        p = A.Var(self.next()[1:]) if self.kind == "var" else self.iri_or_a()
        return A.Triple(s, p, self.term())

    def turnstile(self) -> bool:
        if self.kind == "pname" and self.text == ":" and self.toks[self.i + 1][1] == "-":
            self.i += 2
            return True
        return False

    def rule(self) -> Rule:
        head = None if self.turnstile() else self.atom()
        body: list = []
        neg: list = []
        guards: list = []
        assigns: list = []
        aggs: list = []
        if head is None or self.turnstile():
            while True:
                if self.taken("not"):
                    neg.append(self.atom())
                elif self.word("count", "sum", "min", "max", "avg") and self.toks[self.i + 1][1] == "(":
                    fn = self.next().lower()
                    self.need("(")
                    v = self.next()[1:]
                    self.needed("where")
                    atom = self.atom()
                    self.need(")")
                    self.need("=")
                    aggs.append(Aggregate(fn, v, atom, self.next()[1:]))
                elif self.kind == "var" and self.toks[self.i + 1][1].lower() == "is":
                    v = self.next()[1:]
                    self.next()
                    assigns.append((v, self.sum()))
                elif self.kind == "var" and self.toks[self.i + 1][1] in ("=", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/") or self.kind == "word" and self.text != "a" and self.toks[self.i + 1][1] == "(":
                    guards.append(self.relation())
                else:
                    body.append(self.atom())
                if not self.take(","):
                    break
        self.need(".")
        weight, name = 1.0, ""
        while self.kind == "lang":
            tag = self.next()[1:]
            self.need("(")
            if tag == "weight":
                weight = float(self.term().lex)
            else:
                name = self.term().lex
            self.need(")")
        r = Rule(head, tuple(body), tuple(neg), tuple(guards), tuple(assigns), tuple(aggs), weight, name)
        bound = {n for t in body for n in _names(t)} | {v for v, _ in assigns} | {a.result for a in aggs} | {n for a in aggs for n in _names(a.atom) if n != a.var}
        if head is not None and not _names(head) <= bound:
            raise DatalogError(f"unsafe rule: {_names(head) - bound} in the head only")
        return r


def parse_rules(text: str, prefixes: dict[str, str] | None = None) -> list[Rule]:
    try:
        return _Rules(re.sub(r"%[^\n]*", "", text), prefixes).rules()
    except (SparqlError, IndexError) as e:
        raise DatalogError(str(e)) from e


def _names(t: A.Triple) -> set[str]:
    return {x.name for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}


def _predicate(t: A.Triple) -> str:
    """The dependency-graph node of an atom: its predicate, with the class for types; ``*`` for a variable."""
    if isinstance(t.p, A.Var):
        return "*"
    if t.p.value == A.RDF + "type":
        return f"{t.p.value} {t.o.value}" if isinstance(t.o, A.Iri) else f"{t.p.value} *"
    return t.p.value


def _feeds(head: str, body: str) -> bool:
    if "*" in (head, body):
        return True
    ty = A.RDF + "type"
    return head == body or (head.startswith(ty) and body.startswith(ty) and (head.endswith(" *") or body.endswith(" *")))


def stratify(rules: list[Rule]) -> list[list[Rule]]:
    """Strata in order; a cycle through negation or an aggregate is an error."""
    derived = [r for r in rules if r.head is not None]
    level = {i: 0 for i in range(len(derived))}
    for _ in range(len(derived) + 1):
        changed = False
        for i, r in enumerate(derived):
            for j, q in enumerate(derived):
                h = _predicate(q.head)
                need = level[i]
                if any(_feeds(h, _predicate(t)) for t in r.body):
                    need = max(need, level[j])
                if any(_feeds(h, _predicate(t)) for t in (*r.negated, *(a.atom for a in r.aggregates))):
                    need = max(need, level[j] + 1)
                if need > level[i]:
                    level[i], changed = need, True
        if not changed:
            break
        if max(level.values(), default=0) > len(derived):
            raise DatalogError("the rules can't be stratified: a cycle runs through negation or an aggregate")
    else:
        raise DatalogError("the rules can't be stratified: a cycle runs through negation or an aggregate")
    return [[derived[i] for i in level if level[i] == n] for n in sorted(set(level.values()))]


def without_subsumed(rules: list[Rule]) -> tuple[list[Rule], list[Rule]]:
    """Rules that no other, more general rule (same head and a part of the body, up to renaming) makes needless, and the rest."""

    def covers(a: Rule, b: Rule) -> bool:
        if a is b or a.head is None or b.head is None or a.aggregates or b.aggregates or len(a.body) > len(b.body):
            return False

        def bind(x: Any, y: Any, m: dict) -> dict | None:
            if isinstance(x, A.Var):
                return m | {x.name: y} if m.get(x.name, y) == y else None
            return m if x == y else None

        def triple(t: A.Triple, u: A.Triple, m: dict | None) -> dict | None:
            for x, y in ((t.s, u.s), (t.p, u.p), (t.o, u.o)):
                m = None if m is None else bind(x, y, m)
            return m

        def search(i: int, m: dict | None) -> bool:
            if m is None:
                return False
            return i == len(a.body) or any(search(i + 1, triple(a.body[i], u, m)) for u in b.body)

        return not a.negated and not a.guards and not a.assigns and search(0, triple(a.head, b.head, {}))

    gone: list[Rule] = []
    for i, r in enumerate(rules):
        if any(q not in gone and covers(q, r) and not (covers(r, q) and j > i) for j, q in enumerate(rules)):
            gone.append(r)
    return [r for r in rules if r not in gone], gone


class _Facts:
    """A source for the compiler: facts (s, p, o), or the last round's where the pattern is the delta's."""

    def __init__(self, spark: SparkSession, df: DataFrame):
        self.spark, self.df = spark, df

    def star(self, s: Any, pairs: list, ctx: Context) -> list:
        c, out = Compiler(self), None
        for p, o in pairs:
            part = match(self.df, A.Triple(s, p, o))
            out = part if out is None else c.join(out, part)
        return [(out.df, out.types)]

    def nodes(self, ctx: Context) -> tuple:
        return self.df.select(F.explode(F.array("s", "o")).alias("n")).distinct(), TERM

    def graphs(self) -> list[str]:
        return []


def match(facts: DataFrame, t: A.Triple) -> Solutions:
    vals: dict[str, Val] = {}
    df = facts
    for c, x in (("s", t.s), ("p", t.p), ("o", t.o)):
        val = Val(TERM, facts[c]) if c != "p" else Val(V.IRI, facts[c])
        if isinstance(x, A.Var):
            if x.name in vals:
                df = df.where(V.same_term(vals[x.name], val))
            else:
                vals[x.name] = val
        else:
            want = V.constant(x)
            df = df.where(facts[c] == (V.to_term(want) if c != "p" else want.col))
    return Solutions(df.select(*[v.col.alias(n) for n, v in vals.items()]), {n: v.type for n, v in vals.items()})


def _body(rule: Rule, facts: DataFrame, delta: DataFrame | None, at: int | None) -> Solutions:
    spark = facts.sparkSession
    c = Compiler(_Facts(spark, facts))
    order = list(range(len(rule.body)))
    if at is not None:
        order.sort(key=lambda i: i != at)  # the delta first: it is small
    out: Solutions | None = None
    left = order[:]
    while left:
        i = next((i for i in left if out is None or _names(rule.body[i]) & set(out.types)), left[0])
        left.remove(i)
        part = match(delta if i == at else facts, rule.body[i])
        out = part if out is None else c.join(out, part)
    if len(rule.body) == 1 and not rule.aggregates and not rule.negated:  # joins shuffle; here the heads' distinct would run where files are read
        out = Solutions(dealt(out.df), out.types, out.maybe)
    for agg in rule.aggregates:
        inner = match(facts, agg.atom)
        keys = [n for n in inner.types if n != agg.var]
        typ, col = c.aggregate(A.Agg(agg.fn, A.Var(agg.var)), inner, {n: inner.val(n) for n in inner.types}, Context())
        grouped = inner.df.groupBy(*keys).agg(col.alias(agg.result))
        part = Solutions(grouped, {n: inner.types[n] for n in keys} | {agg.result: typ})
        out = part if out is None else c.join(out, part)
    out = out if out is not None else c.unit()
    for v, e in rule.assigns:
        val = c.expression(e, {n: out.val(n) for n in out.types}, Context())
        out = Solutions(out.df.withColumn(v, val.col).where(F.col(v).isNotNull()), out.types | {v: val.type}, out.maybe)
    for g in rule.guards:
        out = c._filtered(out, g, Context())
    for n in rule.negated:
        out = Solutions(c._semi(out, A.Exists(A.Bgp((n,)), False), Context(), "left_anti"), out.types, out.maybe)
    return out


def _head(rule: Rule, s: Solutions) -> DataFrame:
    of = lambda x: s.val(x.name) if isinstance(x, A.Var) else V.constant(x)
    t = rule.head
    return s.df.select(V.to_term(of(t.s)).alias("s"), V.lexical(of(t.p)).alias("p"), V.to_term(of(t.o)).alias("o")).where("s is not null and p is not null and o is not null")


@dataclass
class Inference:
    facts: DataFrame  # told and derived
    derived: DataFrame
    rounds: int
    eliminated: list[Rule] = field(default_factory=list)


@in_rounds
def infer(facts: DataFrame, rules: list[Rule], *, subsumption: bool = True, max_rounds: int = MAX_ROUNDS) -> Inference:
    """All that follows from facts (s, p, o) by the rules, stratum by stratum."""
    rules, gone = without_subsumed(rules) if subsumption else (rules, [])
    known = facts.select(*TRIPLE)
    told, rounds = known, 0
    everything: list[DataFrame] = []
    for stratum in stratify(rules):
        delta: DataFrame | None = None
        heads = [_predicate(r.head) for r in stratum]
        recursive = [r for r in stratum if any(_feeds(h, _predicate(t)) for h in heads for t in r.body)]
        while rounds < max_rounds:
            rounds += 1
            parts = []
            for r in stratum if delta is None else recursive:
                if delta is None:
                    parts.append(_head(r, _body(r, known, None, None)))
                else:
                    parts += [_head(r, _body(r, known, delta, i)) for i, t in enumerate(r.body) if any(_feeds(h, _predicate(t)) for h in heads)]
            new = parts[0]
            for p in parts[1:]:
                new = new.unionByName(p)
            new = written(new.distinct().join(known, TRIPLE, "left_anti"))
            if new.isEmpty():
                break
            known, delta = known.unionByName(new), new
            everything.append(new)
            if not recursive:
                break
        else:
            raise DatalogError(f"no fixpoint after {max_rounds} rounds")
    derived = everything[0] if everything else told.where("false")
    for e in everything[1:]:
        derived = derived.unionByName(e)
    return Inference(known, derived, rounds, gone)


def sliced(rules: list[Rule], goals: list[A.Triple]) -> list[Rule]:
    """The rules that any of the goals can depend on."""
    want, out = [_predicate(g) for g in goals], []
    while True:
        more = [r for r in rules if r not in out and r.head is not None and any(_feeds(_predicate(r.head), w) for w in want)]
        if not more:
            return out
        out += more
        want += [_predicate(t) for r in more for t in (*r.body, *r.negated, *(a.atom for a in r.aggregates))]


def specialised(rules: list[Rule], goal: A.Triple) -> list[Rule]:
    """Right- or left-linear transitive rules of the goal's predicate with the goal's constant put in, so that only what it reaches is derived."""
    out = []
    for r in rules:
        h = r.head
        keep = r
        if _predicate(h) == _predicate(goal) and not r.negated and not r.aggregates and not isinstance(goal.p, A.Var):
            own = [t for t in r.body if _predicate(t) == _predicate(goal)]
            if isinstance(goal.s, A.Iri) and isinstance(h.s, A.Var) and all(t.s == h.s for t in own):
                keep = _put(r, h.s.name, goal.s)
            elif isinstance(goal.o, A.Iri) and isinstance(h.o, A.Var) and all(t.o == h.o for t in own):
                keep = _put(r, h.o.name, goal.o)
        out.append(keep)
    own = [r for r in out if _predicate(r.head) == _predicate(goal)]
    others = [r for r in out if r not in own]
    used = any(_feeds(_predicate(goal), _predicate(t)) for r in others for t in (*r.body, *r.negated))
    return rules if used or any(r in rules for r in own) else out


def _put(r: Rule, var: str, value: Any) -> Rule:
    sub = lambda x: value if isinstance(x, A.Var) and x.name == var else x
    triple = lambda t: A.Triple(sub(t.s), sub(t.p), sub(t.o))
    expr = lambda e: A.Call(e.op, tuple(expr(x) for x in e.args)) if isinstance(e, A.Call) else sub(e)
    return replace(r, head=triple(r.head), body=tuple(map(triple, r.body)), guards=tuple(map(expr, r.guards)), assigns=tuple((v, expr(e)) for v, e in r.assigns))


def infer_goal(facts: DataFrame, rules: list[Rule], goal: A.Triple) -> DataFrame:
    """Facts that match the goal, deriving only what it can depend on."""
    out = infer(facts, specialised(sliced(rules, [goal]), goal))
    s = match(out.facts, goal)
    of = lambda x: V.to_term(s.val(x.name)) if isinstance(x, A.Var) else V.to_term(V.constant(x))
    p = s.df[goal.p.name] if isinstance(goal.p, A.Var) else F.lit(goal.p.value)
    return s.df.select(of(goal.s).alias("s"), p.alias("p"), of(goal.o).alias("o")).distinct()


def infer_demand(facts: DataFrame, rules: list[Rule], goals: list[A.Triple]) -> Inference:
    """Derives what a number of goals can depend on, once."""
    return infer(facts, sliced(rules, goals))


@in_rounds
def well_founded(facts: DataFrame, rules: list[Rule], max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """True and unknown facts of rules whose negation may be cyclic, by the alternating fixpoint."""

    def least(against: DataFrame) -> DataFrame:
        known, delta, first = facts.select(*TRIPLE), None, True
        while True:
            parts = []
            for r in rules:
                positive = replace(r, negated=())
                for i in [None] if first else range(len(r.body)):
                    s = _body(positive, known, delta, i)
                    c = Compiler(_Facts(facts.sparkSession, against))
                    for n in r.negated:
                        s = Solutions(c._semi(s, A.Exists(A.Bgp((n,)), False), Context(), "left_anti"), s.types, s.maybe)
                    parts.append(_head(r, s))
            new = parts[0]
            for p in parts[1:]:
                new = new.unionByName(p)
            new = written(new.distinct().join(known, TRIPLE, "left_anti"))
            if new.isEmpty():
                return written(known)
            known, delta, first = known.unionByName(new), new, False

    low = facts.select(*TRIPLE)
    size = -1
    for _ in range(max_rounds):
        high = least(low)
        low = least(high)
        n = low.count()
        if n == size:
            break
        size = n
    else:
        raise DatalogError(f"no fixpoint after {max_rounds} rounds")
    told = facts.select(*TRIPLE)
    return written(low.join(told, TRIPLE, "left_anti")), written(high.join(low, TRIPLE, "left_anti"))


@in_rounds
def lattice(edges: DataFrame, values: DataFrame, join: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Least fixpoint of values (s, v) pushed along edges (s, o): join is min, max, set (of arrays) or hull (struct lo, hi)."""
    spread = {"min": F.min("v"), "max": F.max("v"), "set": F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))), "hull": F.struct(F.min("v.lo").alias("lo"), F.max("v.hi").alias("hi"))}[join]
    now = written(values.groupBy("s").agg(spread.alias("v")))
    changed = now
    for _ in range(max_rounds):
        pushed = changed.join(edges, "s").select(F.col("o").alias("s"), "v")
        nxt = now.unionByName(pushed).groupBy("s").agg(spread.alias("v"))
        both = nxt.join(now.withColumnRenamed("v", "w"), "s", "left")
        marked = written(both.select("s", "v", (~F.col("v").eqNullSafe(F.col("w"))).alias("new")))
        now, changed = marked.select("s", "v"), marked.where("new").select("s", "v")
        if changed.isEmpty():
            return now
    raise DatalogError(f"no fixpoint after {max_rounds} rounds")


def violations(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, binding) for each solution of a constraint."""
    parts = []
    for i, r in enumerate(x for x in rules if x.head is None):
        s = _body(r, facts.select(*TRIPLE), None, None)
        parts.append(s.df.select(F.lit(r.name or f"constraint {i}").alias("rule"), F.concat_ws(" ", *[F.concat(F.lit(f"?{n}="), V.shown(V.to_term(s.val(n)))) for n in sorted(s.types)]).alias("binding")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def derivations(result: Inference, rules: list[Rule]) -> DataFrame:
    """(rule, s, p, o, because): each derivation of each derived fact, with its antecedents in N-Triples syntax."""
    parts = []
    for r in rules:
        if r.head is None:
            continue
        s = _body(r, result.facts, None, None)
        of = lambda x, s=s: s.val(x.name) if isinstance(x, A.Var) else V.constant(x)
        why = F.array(*[F.concat_ws(" ", V.shown(V.to_term(of(t.s))), F.concat(F.lit("<"), V.lexical(of(t.p)), F.lit(">")), V.shown(V.to_term(of(t.o)))) for t in r.body])
        parts.append(s.df.select(F.lit(r.text).alias("rule"), V.to_term(of(r.head.s)).alias("s"), V.lexical(of(r.head.p)).alias("p"), V.to_term(of(r.head.o)).alias("o"), why.alias("because")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().join(result.derived, TRIPLE, "left_semi")


def justify(result: Inference, rules: list[Rule], fact: str, depth: int = 20) -> dict:
    """A proof tree of a fact given in N-Triples syntax (without the dot); collects only the branches that it needs."""
    d = derivations(result, rules).withColumn("fact", F.concat_ws(" ", V.shown(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), V.shown(F.col("o"))))

    def proof(f: str, path: tuple) -> dict:
        for r in d.where(F.col("fact") == f).select("rule", "because").limit(20).collect():
            if not set(r.because) & {*path, f} and len(path) < depth:
                return {"fact": f, "rule": r.rule, "because": [proof(b, (*path, f)) for b in r.because]}
        return {"fact": f, "rule": None, "because": []}

    return proof(fact, ())


@in_rounds
def weighted(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(s, p, o, confidence) of one pass of weighted rules over facts (s, p, o, confidence): products, joined by noisy-or."""
    parts = []
    for r in rules:
        plain = facts.select(*TRIPLE)
        s = _body(r, plain, None, None)
        c = F.lit(float(r.weight))
        df = s.df
        for i, t in enumerate(r.body):
            of = lambda x, s=s: s.val(x.name) if isinstance(x, A.Var) else V.constant(x)
            conf = dealt(facts, *TRIPLE).groupBy(*TRIPLE).agg(F.max("confidence").alias(f"__c{i}")).withColumnsRenamed({k: f"__{k}{i}" for k in TRIPLE})
            df = df.join(conf, (V.to_term(of(t.s)) == conf[f"__s{i}"]) & (V.lexical(of(t.p)) == conf[f"__p{i}"]) & (V.to_term(of(t.o)) == conf[f"__o{i}"]))
            c = c * F.col(f"__c{i}")
        s2 = Solutions(df, s.types)
        of = lambda x, s2=s2: s2.val(x.name) if isinstance(x, A.Var) else V.constant(x)
        parts.append(df.select(V.to_term(of(r.head.s)).alias("s"), V.lexical(of(r.head.p)).alias("p"), V.to_term(of(r.head.o)).alias("o"), c.alias("confidence")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out.groupBy(*TRIPLE).agg(noisy_or("confidence").alias("confidence")))


def noisy_or(column: str):
    """1 - product of (1 - c)."""
    return F.when(F.max(column) >= 1, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.log1p(-F.least(F.col(column), F.lit(1 - 1e-15))))))


@in_rounds
def hypothetical(facts: DataFrame, rules: list[Rule], assume: DataFrame | None = None, retract: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Derived facts that would come, and that would go, if some facts were added and others taken away."""
    before = infer(facts, rules).derived
    changed = facts.select(*TRIPLE)
    if retract is not None:
        changed = changed.join(retract.select(*TRIPLE), TRIPLE, "left_anti")
    if assume is not None:
        changed = dealt(changed.unionByName(assume.select(*TRIPLE))).distinct()
    after = infer(changed, rules).derived
    return written(after.join(before, TRIPLE, "left_anti")), written(before.join(after, TRIPLE, "left_anti"))


@in_rounds
def retract(facts: DataFrame, derived: DataFrame, rules: list[Rule], gone: DataFrame) -> Inference:
    """Delete and re-derive: derived facts whose derivation used a deleted one are dropped and derived again where they still follow."""
    told = facts.select(*TRIPLE).join(gone.select(*TRIPLE), TRIPLE, "left_anti")
    everything = written(dealt(facts.select(*TRIPLE).unionByName(derived.select(*TRIPLE))).distinct())
    suspect = frontier = written(dealt(gone.select(*TRIPLE)).distinct())
    while not frontier.isEmpty():
        parts = [_head(r, _body(r, everything, frontier, i)) for r in rules if r.head is not None for i in range(len(r.body))]
        new = parts[0]
        for p in parts[1:]:
            new = new.unionByName(p)
        frontier = written(new.distinct().join(suspect, TRIPLE, "left_anti"))
        suspect = suspect.unionByName(frontier)
    sound = told.unionByName(derived.select(*TRIPLE).join(suspect, TRIPLE, "left_anti")).distinct()
    out = infer(written(sound), rules)
    return Inference(out.facts, written(out.facts.join(told, TRIPLE, "left_anti")), out.rounds)


def same_as(facts: DataFrame) -> DataFrame:
    """(node, canonical): the smallest term of each owl:sameAs component."""
    return components(facts.where(F.col("p") == A.OWL + "sameAs").select("s", "o")).withColumnRenamed("component", "canonical")


def canonicalised(facts: DataFrame) -> DataFrame:
    """facts with each term replaced by its owl:sameAs representative."""
    m = same_as(facts)
    out = facts
    for c in ("s", "o"):
        names = m.select(F.col("node").alias(c), F.col("canonical").alias("__c"))
        out = out.join(names, c, "left").withColumn(c, F.coalesce("__c", c)).drop("__c")
    return out.select(*facts.columns).distinct()


_R, _S, _O = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf"
_PREFIXES = {"rdf": A.RDF, "rdfs": A.RDFS, "owl": A.OWL, "skos": A.SKOS, "skosxl": "http://www.w3.org/2008/05/skos-xl#", "dcterms": "http://purl.org/dc/terms/", "schema": "https://schema.org/", "foaf": "http://xmlns.com/foaf/0.1/"}
RULE_SETS: dict[str, str] = {
    "rdfs": """?x ?q ?y :- ?p rdfs:subPropertyOf ?q, ?x ?p ?y . ?p rdfs:subPropertyOf ?r :- ?p rdfs:subPropertyOf ?q, ?q rdfs:subPropertyOf ?r .
      ?x a ?c :- ?p rdfs:domain ?c, ?x ?p ?y . ?y a ?c :- ?p rdfs:range ?c, ?x ?p ?y . ?x a ?d :- ?c rdfs:subClassOf ?d, ?x a ?c . ?c rdfs:subClassOf ?e :- ?c rdfs:subClassOf ?d, ?d rdfs:subClassOf ?e .""",
    "owl-rl": """?y ?p ?x :- ?p a owl:SymmetricProperty, ?x ?p ?y . ?x ?p ?z :- ?p a owl:TransitiveProperty, ?x ?p ?y, ?y ?p ?z . ?y ?q ?x :- ?p owl:inverseOf ?q, ?x ?p ?y . ?y ?p ?x :- ?p owl:inverseOf ?q, ?x ?q ?y .
      ?x ?q ?y :- ?p owl:equivalentProperty ?q, ?x ?p ?y . ?x ?p ?y :- ?p owl:equivalentProperty ?q, ?x ?q ?y . ?x a ?d :- ?c owl:equivalentClass ?d, ?x a ?c . ?x a ?c :- ?c owl:equivalentClass ?d, ?x a ?d .
      ?y owl:sameAs ?z :- ?p a owl:FunctionalProperty, ?x ?p ?y, ?x ?p ?z, ?y != ?z . ?x owl:sameAs ?z :- ?p a owl:InverseFunctionalProperty, ?x ?p ?y, ?z ?p ?y, ?x != ?z .
      ?y owl:sameAs ?x :- ?x owl:sameAs ?y . ?x a ?c :- ?c owl:hasValue ?v, ?c owl:onProperty ?p, ?x ?p ?v . ?x ?p ?v :- ?c owl:hasValue ?v, ?c owl:onProperty ?p, ?x a ?c . ?x a ?c :- ?c owl:someValuesFrom ?d, ?c owl:onProperty ?p, ?x ?p ?y, ?y a ?d . ?y a ?d :- ?c owl:allValuesFrom ?d, ?c owl:onProperty ?p, ?x a ?c, ?x ?p ?y .
      :- ?c owl:disjointWith ?d, ?x a ?c, ?x a ?d . @name("disjoint classes")""",
    "skos": "?y skos:narrower ?x :- ?x skos:broader ?y . ?y skos:broader ?x :- ?x skos:narrower ?y . ?y skos:related ?x :- ?x skos:related ?y . ?c skos:inScheme ?s :- ?c skos:topConceptOf ?s . ?s skos:hasTopConcept ?c :- ?c skos:topConceptOf ?s . ?c skos:topConceptOf ?s :- ?s skos:hasTopConcept ?c . ?y skos:exactMatch ?x :- ?x skos:exactMatch ?y . ?y skos:closeMatch ?x :- ?x skos:closeMatch ?y .",
    "skos-transitive": "?x skos:broaderTransitive ?y :- ?x skos:broader ?y . ?x skos:broaderTransitive ?z :- ?x skos:broaderTransitive ?y, ?y skos:broaderTransitive ?z . ?y skos:narrowerTransitive ?x :- ?x skos:broaderTransitive ?y .",
}
RULE_SETS["skosxl"] = "?x skos:prefLabel ?t :- ?x skosxl:prefLabel ?l, ?l skosxl:literalForm ?t . ?x skos:altLabel ?t :- ?x skosxl:altLabel ?l, ?l skosxl:literalForm ?t . ?x skos:hiddenLabel ?t :- ?x skosxl:hiddenLabel ?l, ?l skosxl:literalForm ?t . ?m skosxl:labelRelation ?l :- ?l skosxl:labelRelation ?m ."
RULE_SETS["dcterms"] = "?y dcterms:hasPart ?x :- ?x dcterms:isPartOf ?y . ?y dcterms:isPartOf ?x :- ?x dcterms:hasPart ?y . ?y dcterms:replaces ?x :- ?x dcterms:isReplacedBy ?y . ?y dcterms:isReplacedBy ?x :- ?x dcterms:replaces ?y . ?y dcterms:isVersionOf ?x :- ?x dcterms:hasVersion ?y . ?y dcterms:hasVersion ?x :- ?x dcterms:isVersionOf ?y . ?y dcterms:references ?x :- ?x dcterms:isReferencedBy ?y . ?y dcterms:isReferencedBy ?x :- ?x dcterms:references ?y . ?y dcterms:requires ?x :- ?x dcterms:isRequiredBy ?y . ?y dcterms:isRequiredBy ?x :- ?x dcterms:requires ?y . ?x dcterms:contributor ?y :- ?x dcterms:creator ?y ."
RULE_SETS["schema"] = "?x a schema:Thing :- ?x schema:name ?n . ?y schema:hasPart ?x :- ?x schema:isPartOf ?y . ?y schema:isPartOf ?x :- ?x schema:hasPart ?y . ?y schema:memberOf ?x :- ?x schema:member ?y . ?y schema:member ?x :- ?x schema:memberOf ?y . ?y schema:subOrganization ?x :- ?x schema:parentOrganization ?y . ?y schema:parentOrganization ?x :- ?x schema:subOrganization ?y . ?y schema:containedInPlace ?x :- ?x schema:containsPlace ?y . ?y schema:containsPlace ?x :- ?x schema:containedInPlace ?y . ?y schema:knows ?x :- ?x schema:knows ?y ."
RULE_SETS["foaf"] = "?x a foaf:Agent :- ?x a foaf:Person . ?x a foaf:Agent :- ?x a foaf:Organization . ?x a foaf:Agent :- ?x a foaf:Group . ?x a foaf:Person :- ?x foaf:knows ?y . ?y a foaf:Person :- ?x foaf:knows ?y . ?y foaf:made ?x :- ?x foaf:maker ?y . ?y foaf:maker ?x :- ?x foaf:made ?y . ?y foaf:depiction ?x :- ?x foaf:depicts ?y . ?y foaf:depicts ?x :- ?x foaf:depiction ?y . ?y foaf:primaryTopic ?x :- ?x foaf:isPrimaryTopicOf ?y . ?y foaf:isPrimaryTopicOf ?x :- ?x foaf:primaryTopic ?y . ?g a foaf:Group :- ?g foaf:member ?x . ?x a foaf:Agent :- ?g foaf:member ?x ."
RULE_SETS["owl-el"] = RULE_SETS["rdfs"] + " ?x a ?c :- ?c owl:someValuesFrom ?d, ?c owl:onProperty ?p, ?x ?p ?y, ?y a ?d . ?x a ?d :- ?c owl:equivalentClass ?d, ?x a ?c . ?x a ?c :- ?c owl:equivalentClass ?d, ?x a ?d ."
RULE_SETS["owl-ql"] = RULE_SETS["rdfs"] + " ?y ?q ?x :- ?p owl:inverseOf ?q, ?x ?p ?y . ?y ?p ?x :- ?p a owl:SymmetricProperty, ?x ?p ?y ."
RULE_SETS["owl-rl"] = RULE_SETS["rdfs"] + RULE_SETS["owl-rl"]


def rule_set(name: str) -> list[Rule]:
    return parse_rules(RULE_SETS[name], _PREFIXES)


def list_rules(facts: DataFrame, spark: SparkSession) -> list[Rule]:
    """owl:propertyChainAxiom and owl:intersectionOf of the facts as rules, with their lists' contents."""
    told = facts.where(F.col("p").isin(A.RDF + "first", A.RDF + "rest", A.OWL + "propertyChainAxiom", A.OWL + "intersectionOf")).select("s.lex", "p", "o.lex").toDF("s", "p", "o").limit(MOST_AXIOMS + 1).collect()
    if len(told) > MOST_AXIOMS:
        raise DatalogError(f"more than {MOST_AXIOMS} statements of property chains and intersections")
    first, rest = {r.s: r.o for r in told if r.p.endswith("first")}, {r.s: r.o for r in told if r.p.endswith("rest")}
    out = []
    for r in told:
        if r.p.endswith(("first", "rest")):
            continue
        items, at = [], r.o
        while at in first:
            items.append(A.Iri(first[at]))
            at = rest.get(at)
        if r.p.endswith("propertyChainAxiom"):
            out.append(Rule(A.Triple(A.Var("v0"), A.Iri(r.s), A.Var(f"v{len(items)}")), tuple(A.Triple(A.Var(f"v{i}"), p, A.Var(f"v{i + 1}")) for i, p in enumerate(items))))
        elif items:
            ty = A.Iri(A.RDF + "type")
            out.append(Rule(A.Triple(A.Var("x"), ty, A.Iri(r.s)), tuple(A.Triple(A.Var("x"), ty, c) for c in items)))
            out += [Rule(A.Triple(A.Var("x"), ty, c), (A.Triple(A.Var("x"), ty, A.Iri(r.s)),)) for c in items]
    return out


def conflicts(rules: list[Rule]) -> list[tuple[str, str]]:
    """Pairs of rules of which one derives what another's negation relies on the absence of."""
    return [(a.text, b.text) for a in rules if a.head is not None for b in rules for n in b.negated if a is not b and _feeds(_predicate(a.head), _predicate(n))]


def explain(rules: list[Rule]) -> list[dict]:
    return [{"stratum": i, "rules": [r.text for r in s], "recursive": any(_feeds(_predicate(q.head), _predicate(t)) for r in s for q in s for t in r.body)} for i, s in enumerate(stratify(rules))]
