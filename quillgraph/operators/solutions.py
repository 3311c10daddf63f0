"""Bags of solutions: a DataFrame with a column a variable, and the operators of graph patterns on it.

Which variables may be unbound is known from how a bag was made, so that joins are plain equi-joins wherever they can
be, and only variables that may be unbound are split into their bound and unbound rows. Nothing is evaluated before
an action on `.df`.

A variable that comes from a mapped table has companions beside its term: the stored columns that the term was made from. Joins are on
companions where both sides have them, and s["x"] gives functions of terms the value, so no text is built or parsed for a term that isn't
returned, and conditions reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T

Kind = tuple[str, ...]  # ("key", prefix, types...) or ("value", Spark type)


def companion(variable: str, i: int) -> str:
    return f"__{variable}__{i}"


def width(kind: Kind) -> int:
    return len(kind) - 2 if kind[0] == "key" else 1


class Solutions:
    def __init__(self, df: DataFrame, maybe: Iterable[str] = (), kinds: dict[str, Kind] | None = None):
        """df: a column a variable, and companion columns of the variables in kinds."""
        self.rows = df
        self.kinds = {v: k for v, k in (kinds or {}).items() if v in df.columns}
        self.maybe = frozenset(maybe) & frozenset(df.columns)

    @property
    def variables(self) -> list[str]:
        return [c for c in self.rows.columns if c[:2] != "__"]

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(*self._companions(*self.kinds)) if self.kinds else self.rows

    def _companions(self, *variables: str) -> list[str]:
        return [companion(v, i) for v in variables if v in self.kinds for i in range(width(self.kinds[v]))]

    def __getitem__(self, variable: str) -> Column | T.Typed:
        """A variable for the functions of terms: with its value where it has one."""
        kind = self.kinds.get(variable)
        return T.Typed(F.col(variable), F.col(companion(variable, 0)), kind[1]) if kind and kind[0] == "value" else F.col(variable)

    def key(self, variable: str, i: int = 0) -> Column:
        """A part of the key that a mapped resource's name was made from."""
        if self.kinds.get(variable, ("",))[0] != "key":
            raise KeyError(f"{variable} is no mapped resource")
        return F.col(companion(variable, i))

    # joins

    def _agree(self, other: Solutions, shared: list[str]) -> tuple[DataFrame, Column, list[str]]:
        """other, its shared variables and companions renamed; the condition that these (bound) variables agree; and what to drop then."""
        names = [v for v in self.variables if v in other.variables]
        right = other.rows.withColumnsRenamed({c: f"__r_{c}" for c in [*names, *other._companions(*names)]})
        same = F.lit(True)
        for v in shared:
            kind = self.kinds.get(v)
            exact = kind and kind == other.kinds.get(v) and kind[-1] not in ("double", "float")
            for c in self._companions(v) if exact else [v]:
                same = same & (F.col(c) == F.col(f"__r_{c}"))
        return right, same, [f"__r_{c}" for c in [*names, *other._companions(*names)]]

    def join(self, other: Solutions, product: bool = False) -> Solutions:
        """Compatible mappings: shared variables agree where both are bound. Without shared variables, product=True
        must say that every pair is meant. Rows with an unbound shared variable meet all that agrees in the others."""
        shared = [v for v in self.variables if v in other.variables]
        loose = [v for v in shared if v in self.maybe | other.maybe]
        maybe = (self.maybe - set(shared)) | (other.maybe - set(shared)) | (self.maybe & other.maybe)
        if not loose:
            if not shared and not product:
                raise ValueError("the patterns share no variable; product=True asks for every pair")
            right, same, gone = self._agree(other, shared)
            df = self.rows.join(right, same).drop(*gone) if shared else self.rows.crossJoin(right)
            return Solutions(df, maybe, self._kinds_with(other))
        v = loose[0]
        parts = [self._bound(v).join(other._bound(v), product)]
        if v in self.maybe:
            parts.append(self._free(v).join(other, True))
        if v in other.maybe:
            parts.append(self._bound(v).join(other._free(v), True))
        return parts[0]._with(*parts[1:], maybe=maybe)

    def _kinds_with(self, other: Solutions) -> dict[str, Kind]:
        return {v: k for v, k in other.kinds.items() if v not in self.variables} | self.kinds

    def _bound(self, v: str) -> Solutions:
        return Solutions(self.rows.where(F.col(v).isNotNull()), self.maybe - {v}, self.kinds)

    def _free(self, v: str) -> Solutions:
        return Solutions(self.rows.where(F.col(v).isNull()).drop(v, *self._companions(v)), self.maybe - {v}, {k: x for k, x in self.kinds.items() if k != v})

    def _cases(self, loose: list[str]) -> list[Solutions]:
        """The bag by which of these variables are bound; unbound ones are left out."""
        out = [self]
        for v in loose:
            out = [y for x in out for y in ((x._bound(v), x._free(v)) if v in x.maybe else (x,))]
        return out

    def _with(self, *others: Solutions, maybe: Iterable[str]) -> Solutions:
        """The bags as one; variables keep the companions that all bags having them have."""
        bags = [self, *others]
        every = list(dict.fromkeys(v for b in bags for v in b.variables))
        kinds = {v: found.pop() for v in every if len(found := {b.kinds.get(v) for b in bags if v in b.variables}) == 1 and None not in found}
        rows = (b.rows.drop(*b._companions(*(v for v in b.kinds if v not in kinds))) for b in bags)
        return Solutions(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), maybe, kinds)

    def _sides(self, other: Solutions, product: bool) -> list[str]:
        shared = [v for v in self.variables if v in other.variables]
        if not shared and not product:
            raise ValueError("the patterns share no variable; product=True asks for every pair")
        return [v for v in shared if v in self.maybe | other.maybe]

    def _matches(self, other: Solutions, condition: Column | None, how: str, then_drop: bool = False) -> DataFrame:
        """A join of bags without unbound shared variables, in a form of Spark's."""
        shared = [v for v in self.variables if v in other.variables]
        right, same, gone = self._agree(other, shared)
        if not shared and condition is None and how in ("left_semi", "left_anti"):  # whether there is any row at all
            right, same = right.limit(1), F.lit(True)
        joined = self.rows.join(right, same if condition is None else same & condition, how)
        return joined.drop(*gone) if then_drop else joined

    def optional(self, other: Solutions, condition: Column | None = None, product: bool = False) -> Solutions:
        """Left outer join; the condition sees the variables of both sides. Rows are parted by which shared variables they have, so each
        join is on equal columns; only rows that share nothing bound meet all others."""
        loose = self._sides(other, product)
        maybe = (self.maybe | set(other.variables)) - (set(self.variables) - self.maybe)
        parts = []
        rights = other._cases([v for v in loose if v in other.maybe])
        for mine in self._cases([v for v in loose if v in self.maybe]):
            if len(rights) == 1:
                parts.append(Solutions(mine._matches(rights[0], condition, "left", True), maybe, mine._kinds_with(rights[0])))
                continue
            rest = mine
            for r in rights:
                parts.append(Solutions(mine._matches(r, condition, "inner", True), maybe, mine._kinds_with(r)))
                rest = Solutions(rest._matches(r, condition, "left_anti"), mine.maybe, mine.kinds)
            parts.append(rest)
        return parts[0]._with(*parts[1:], maybe=maybe) if len(parts) > 1 else parts[0]

    def exists(self, other: Solutions, condition: Column | None = None, negated: bool = False, product: bool = False) -> Solutions:
        loose = self._sides(other, product)
        parts = []
        for mine in self._cases([v for v in loose if v in self.maybe]):
            rest = mine
            for r in other._cases([v for v in loose if v in other.maybe]):
                if not negated:
                    parts.append(Solutions(rest._matches(r, condition, "left_semi"), mine.maybe, mine.kinds))
                rest = Solutions(rest._matches(r, condition, "left_anti"), mine.maybe, mine.kinds)
            if negated:
                parts.append(rest)
        return parts[0]._with(*parts[1:], maybe=self.maybe) if len(parts) > 1 else parts[0]

    def not_exists(self, other: Solutions, condition: Column | None = None, product: bool = False) -> Solutions:
        return self.exists(other, condition, True, product)

    def exists_flag(self, other: Solutions, name: str) -> Solutions:
        """A boolean column for EXISTS inside a larger expression, over the shared variables (which must be bound)."""
        shared = [v for v in self.variables if v in other.variables]
        keys = other.rows.select(*shared, *other._companions(*shared)).distinct().withColumn(name, F.lit(True))
        right, same, gone = self._agree(Solutions(keys, (), other.kinds), shared)
        df = self.rows.join(right, same, "left").drop(*gone).withColumn(name, F.coalesce(name, F.lit(False)))
        return Solutions(df, self.maybe, self.kinds)

    def union(self, *others: Solutions) -> Solutions:
        bags = [self, *others]
        every = {v for b in bags for v in b.variables}
        return self._with(*others, maybe={v for v in every if any(v in b.maybe or v not in b.variables for b in bags)})

    # rows

    def filter(self, condition: Column | Callable[[Solutions], Column]) -> Solutions:
        """A condition, or a function that gets the bag: lambda s: T.num(s["x"]) > 5."""
        return Solutions(self.rows.where(condition if isinstance(condition, Column) else condition(self)), self.maybe, self.kinds)

    def bind(self, variable: str, value: Column | Callable[[Solutions], Column], maybe: bool = False) -> Solutions:
        value = value if isinstance(value, Column) else value(self)
        return Solutions(self.rows.withColumn(variable, value), self.maybe | ({variable} if maybe else set()), {v: k for v, k in self.kinds.items() if v != variable})

    def values(self, variable: str, terms: list[str]) -> Solutions:
        """A join with inline terms: a filter where the variable is bound already."""
        inline = Solutions(self.rows.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], f"`{variable}` string"))
        return self.join(inline, product=True)

    def select(self, *variables: str, distinct: bool = False) -> Solutions:
        wanted = variables or sorted(self.variables)
        if distinct:
            return Solutions(self.rows.select(*wanted).distinct(), self.maybe)
        return Solutions(self.rows.select(*wanted, *self._companions(*wanted)), self.maybe, self.kinds)

    def order_by(self, *keys: str) -> Solutions:
        """Variables, with a minus for descending; terms in SPARQL order, other columns by value."""
        sort: list[Column] = []
        types = dict(self.rows.dtypes)
        for k in keys:
            down, name = k[0] == "-", k.lstrip("-")
            sort += T.order(self[name], down) if types[name] == "string" else [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first()]
        return Solutions(self.rows.orderBy(*sort), self.maybe, self.kinds)

    def slice(self, limit: int | None = None, offset: int = 0) -> Solutions:
        df = self.rows.offset(offset) if offset else self.rows
        return Solutions(df if limit is None else df.limit(limit), self.maybe, self.kinds)

    # groups

    def group(self, *keys: str, **aggregates: Column | Aggregate) -> Solutions:
        """Unbound keys are a group. Without keys there is one row, also over nothing; without aggregates a row a group."""
        if not aggregates:
            return self.select(*keys, distinct=True)
        made = {n: a.make(self) if isinstance(a, Aggregate) else a for n, a in aggregates.items()}
        return Solutions(self.rows.groupBy(*keys).agg(*(a.alias(n) for n, a in made.items())), self.maybe)

    # query forms

    def ask(self) -> DataFrame:
        """result: whether there is a solution."""
        return self.rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def construct(self, *templates: tuple[str, str, str]) -> DataFrame:
        """Triples of the templates for each solution; those with an unbound variable are left out; a set."""
        term = lambda x: F.col(x[1:]) if x[0] == "?" else F.lit(x)
        rows = F.array(*(F.struct(*(term(x).alias(c) for x, c in zip(t, "spo", strict=True))) for t in templates))
        return self.rows.select(F.explode(rows).alias("t")).select("t.s", "t.p", "t.o").dropna().distinct()

    def native(self, **kinds: str) -> DataFrame:
        """A DataFrame of values: variable=Spark type. Other columns stay as they are."""
        named = {v: T.native(self[v], k).alias(v) for v, k in kinds.items()}
        return self.rows.select(*(named.get(c, F.col(c)) for c in self.df.columns))


class Aggregate:
    """A value of a group, made when it is known of what bag."""

    def __init__(self, make: Callable[[Solutions], Column]):
        self.make = make

    def map(self, f: Callable[[Column], Column]) -> Aggregate:
        return Aggregate(lambda s: f(self.make(s)))

    def round(self, places: int) -> Aggregate:
        return self.map(lambda c: F.round(c, places))


def count(variable: str | None = None, distinct: bool = False) -> Column | Aggregate:
    """Rows, or those where a variable is bound; distinct: different solutions, or different terms."""
    if variable is None:
        whole = lambda s: F.countDistinct(F.struct(*s.variables)) if s.variables else F.count_if(F.lit(True)).cast("boolean").cast("long")
        return Aggregate(whole) if distinct else F.count(F.lit(1))
    return F.countDistinct(variable) if distinct else F.count(variable)


def total(variable: str, distinct: bool = False) -> Aggregate:
    """SUM: 0 of nothing."""
    return Aggregate(lambda s: F.coalesce((F.sum_distinct if distinct else F.sum)(T.num(s[variable]).cast("double")), F.lit(0.0)))


def mean(variable: str) -> Aggregate:
    return Aggregate(lambda s: F.avg(T.num(s[variable]).cast("double")))


def extreme(variable: str, largest: bool = False) -> Aggregate:
    """MIN or MAX in SPARQL order; unbound of nothing."""

    def make(s: Solutions) -> Column:
        t = s[variable]
        bound = t.value if isinstance(t, T.Typed) else t
        key = bound if isinstance(t, T.Typed) and t.kind in (*T.NUMBERS, "string") else F.when(bound.isNotNull(), F.struct(T.kind_rank(T.term_of(t)).alias("k"), T.num(t).alias("n"), T.lex(t).alias("x")))
        return (F.max_by if largest else F.min_by)(T.term_of(t), key)

    return Aggregate(make)
