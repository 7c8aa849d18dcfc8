"""Encoders: from columns to design columns. An encoder knows its names and its Columns, and can be written as JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named transforms; `register_transform` adds to them.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x,
    "log": lambda x: F.when(x > 0, F.ln(x)),
    "log1p": lambda x: F.when(x > -1, F.log1p(x)),
    "log2": lambda x: F.when(x > 0, F.log2(x)),
    "log10": lambda x: F.when(x > 0, F.log10(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "exp": F.exp,
    "expm1": F.expm1,
    "abs": F.abs,
    "square": lambda x: x * x,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
}


def register_transform(name: str, f: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = f


def is_registered(name: str) -> bool:
    return name in TRANSFORMS


@dataclass(frozen=True)
class Effects:
    """Deviation coding: a column for each level but the baseline; the baseline is -1 in all, an unknown level or NULL 0."""

    variable: str
    levels: tuple
    baseline: object = None

    @property
    def base(self):
        return self.levels[-1] if self.baseline is None else self.baseline

    def names(self) -> list[str]:
        return [f"{self.variable}.{v}" for v in self.levels if v != self.base]

    def columns(self) -> list[Column]:
        x = F.col(self.variable)
        return [F.when(x == v, 1.0).when(x == self.base, -1.0).otherwise(0.0) for v in self.levels if v != self.base]


@dataclass(frozen=True)
class OneHot:
    """A 0/1 column for each level, but the baseline if there is one."""

    variable: str
    levels: tuple
    baseline: object = None

    def names(self) -> list[str]:
        return [f"{self.variable}.{v}" for v in self.levels if v != self.baseline]

    def columns(self) -> list[Column]:
        return [F.when(F.col(self.variable) == v, 1.0).otherwise(0.0) for v in self.levels if v != self.baseline]


@dataclass(frozen=True)
class Transform:
    """A named transform of a number; the identity if no other is named."""

    variable: str
    transform: str = "identity"

    def names(self) -> list[str]:
        return [self.variable if self.transform == "identity" else f"{self.transform}.{self.variable}"]

    def columns(self) -> list[Column]:
        return [TRANSFORMS[self.transform](F.col(self.variable).cast("double"))]


@dataclass(frozen=True)
class Success:
    """1 for the given values, 0 for others."""

    variable: str
    values: tuple

    def names(self) -> list[str]:
        return [f"{self.variable}.success"]

    def columns(self) -> list[Column]:
        return [F.coalesce(F.col(self.variable).isin(*self.values), F.lit(False)).cast("double")]


@dataclass(frozen=True)
class MissingDummy:
    """A leading 0/1 column for a missing value; the wrapped encoder's columns are 0 there."""

    encoder: object

    @property
    def variable(self) -> str:
        return self.encoder.variable

    def names(self) -> list[str]:
        return [f"{self.variable}.missing", *self.encoder.names()]

    def columns(self) -> list[Column]:
        gone = F.col(self.variable).isNull()
        return [gone.cast("double"), *[F.when(gone, 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in self.encoder.columns()]]


@dataclass(frozen=True)
class Interaction:
    """All products of the columns of two encoders, the first one's outermost."""

    a: object
    b: object

    @property
    def variable(self) -> str:
        return f"{self.a.variable}:{self.b.variable}"

    def names(self) -> list[str]:
        return [f"{x}:{y}" for x in self.a.names() for y in self.b.names()]

    def columns(self) -> list[Column]:
        return [x * y for x in self.a.columns() for y in self.b.columns()]


@dataclass(frozen=True)
class Dataset:
    """Several encoders side by side, behind an intercept if asked."""

    encoders: tuple
    intercept: bool = True

    def names(self) -> list[str]:
        return ["(Intercept)"] * self.intercept + [n for e in self.encoders for n in e.names()]

    def columns(self) -> list[Column]:
        return [F.lit(1.0)] * self.intercept + [c for e in self.encoders for c in e.columns()]

    def variable_map(self) -> dict[str, list[int]]:
        """Which design columns belong to which encoder."""
        out, at = ({"(Intercept)": [0]} if self.intercept else {}), int(self.intercept)
        for e in self.encoders:
            n = len(e.names())
            out.setdefault(e.variable, []).extend(range(at, at + n))
            at += n
        return out


def encode(df: DataFrame, encoder, keep: Sequence[str] = ()) -> DataFrame:
    """The design columns, by name, beside the columns to keep: one projection."""
    return df.select(*keep, *[c.alias(n) for n, c in zip(encoder.names(), encoder.columns(), strict=True)])


@dataclass(frozen=True)
class Computed:
    """A named transform of a SQL expression of columns."""

    variable: str
    transform: str = "identity"

    def names(self) -> list[str]:
        return [f"{self.transform}.{self.variable}"]

    def source(self) -> Column:
        return F.expr(self.variable).cast("double")

    def columns(self) -> list[Column]:
        return [TRANSFORMS[self.transform](self.source())]


_KINDS = {c.__name__: c for c in (Effects, OneHot, Transform, Computed, Success, MissingDummy, Interaction, Dataset)}


def to_json(encoder) -> str:
    def plain(e):
        if type(e).__name__ in _KINDS:
            return {"kind": type(e).__name__} | {k: plain(getattr(e, k)) for k in e.__dataclass_fields__}
        return [plain(x) for x in e] if isinstance(e, tuple) else e

    return json.dumps(plain(encoder))


def from_json(text: str):
    def build(x):
        if isinstance(x, dict):
            return _KINDS[x["kind"]](**{k: build(v) for k, v in x.items() if k != "kind"})
        return tuple(build(v) for v in x) if isinstance(x, list) else x

    return build(json.loads(text))


def levels_of(df: DataFrame, x: str, limit: int = 1000) -> tuple:
    """The sorted levels of a column, for an encoder; an error if there are more than `limit`."""
    found = [r[0] for r in df.filter(F.col(x).isNotNull()).select(x).distinct().orderBy(x).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{x} has more than {limit} levels")
    return tuple(found)


def integer_effects(variable: str, codes: int) -> Effects:
    """Deviation coding of the codes 0 to codes - 1; the last is the baseline."""
    return Effects(variable, tuple(range(codes)))


def interaction(encoders: Sequence) -> object:
    """One encoder of all products of the columns of several, the first one's outermost."""
    out = encoders[0]
    for e in encoders[1:]:
        out = Interaction(out, e)
    return out


def factorial_columns(levels: dict[str, Sequence[str]], order: int) -> Dataset:
    """Treatment coding of several factors (the first level is the baseline) with all interactions up to `order`."""
    return contextual_columns(levels, {}, order)


def contextual_columns(arms: dict[str, Sequence[str]], context: dict[str, Sequence[str]], order: int) -> Dataset:
    """As `factorial_columns`, over what an experiment sets and what it finds: interactions may hold factors of both."""
    single = [OneHot(v, tuple(ls), ls[0]) for v, ls in (arms | context).items()]
    return Dataset(tuple(interaction(group) for k in range(1, order + 1) for group in combinations(single, k)), True)


def bandit_design(contexts: DataFrame, arms: Sequence[dict], encoder, keep: Sequence[str] = ()) -> DataFrame:
    """A design row for each context and arm: an arm's levels take the place of columns of their names, then all is encoded.

    arms: a list of dicts of equal keys, as short as an experiment's; each context is read once and repeated in its own task.
    """
    names = list(arms[0])
    each = F.array(*[F.struct(*[F.lit(arm[n]).alias(n) for n in names]) for arm in arms])
    return encode(contexts.drop(*names).select("*", F.inline(each)), encoder, [*keep, *names])


_TOKEN = re.compile(r"\s*(?:(`[^`]+`|[A-Za-z_]\w*)|(\d+)|([-+*:^().]))")

#: Terms of a formula, each the factors of a product in order, and whether it says that there is an intercept (None: nothing).
_Sum = tuple[list[tuple[str, ...]], "bool | None"]


def _product(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(a + b))


def _joined(sums: Sequence[_Sum]) -> _Sum:
    """All terms, each once whatever the order of its factors, and the last word on the intercept."""
    seen, out = set(), []
    for t in (t for terms, _ in sums for t in terms):
        if frozenset(t) not in seen:
            seen.add(frozenset(t))
            out.append(t)
    said = [i for _, i in sums if i is not None]
    return out, said[-1] if said else None


class _Formula:
    """Reads a right-hand side from left to right: sums of `*`, of `:`, of `^`, of single terms, each binding closer."""

    def __init__(self, text: str, columns: Sequence[str]):
        self.text, self.at, self.columns = text, 0, list(columns)

    def peek(self) -> str:
        found = _TOKEN.match(self.text, self.at)
        return found[0].strip() if found else self.text[self.at :].strip()[:1]

    def take(self) -> str:
        found = _TOKEN.match(self.text, self.at)
        if not found:
            raise ValueError(f"can't read the formula from here: {self.text[self.at :].strip() or 'its end'}")
        self.at = found.end()
        return found[0].strip()

    def sum(self, ends: str) -> _Sum:
        out: _Sum = ([], None)
        sign = self.take() if self.peek() in ("+", "-") and self.peek() else "+"
        while True:
            terms, said = self.crossed()
            if sign == "+":
                out = _joined([out, (terms, said)])
            else:
                gone = {frozenset(t) for t in terms}
                out = [t for t in out[0] if frozenset(t) not in gone], out[1] if said is None else not said
            if self.peek() == ends:
                return out
            sign = self.take()
            if sign not in ("+", "-"):
                raise ValueError(f"can't read the formula at {sign!r}: {self.text}")

    def crossed(self) -> _Sum:
        out = self.multiplied()
        while self.peek() == "*":
            self.take()
            right = self.multiplied()
            out = _joined([out, right, self.between(out, right)])
        return out

    def between(self, a: _Sum, b: _Sum) -> _Sum:
        return [_product(x, y) for x in a[0] for y in b[0]], None

    def multiplied(self) -> _Sum:
        out = self.raised()
        while self.peek() == ":":
            self.take()
            out = _joined([self.between(out, self.raised())])
        return out

    def raised(self) -> _Sum:
        base = out = self.single()
        if self.peek() == "^":
            self.take()
            power = self.take()
            if not power.isdigit() or not int(power):
                raise ValueError(f"a power has to be a whole number above 0: {power}")
            for _ in range(int(power) - 1):
                out = _joined([out, self.between(out, base)])
        return out

    def single(self) -> _Sum:
        token = self.take()
        if token == "(":
            out = self.sum(")")
            self.take()
            return out
        if token == ".":
            return [(c,) for c in self.columns], None
        if token in ("0", "1"):
            return [], token == "1"
        if not re.match(r"[`A-Za-z_]", token):
            raise ValueError(f"can't read the formula at {token!r}: {self.text}")
        if self.peek() == "(" and not token.startswith("`"):
            begin, depth = self.at, 0
            while True:
                if self.at >= len(self.text):
                    raise ValueError(f"a bracket isn't closed: {self.text[begin:]}")
                depth += {"(": 1, ")": -1}.get(self.text[self.at], 0)
                self.at += 1
                if not depth and self.text[self.at - 1] == ")":
                    return [(token + self.text[begin : self.at].strip(),)], None
        return [(token.strip("`"),)], None


def formula(df: DataFrame, right: str, omit: Sequence[str] = ()) -> Dataset:
    """The encoder of a right-hand side such as "a * b:c + log(d + 1) - a:b - 1", by the columns of df.

    `a:b` is the product, `a * b` is a + b + a:b, `(a + b)^2` is (a + b) * (a + b), and `:` binds closer than `*`. `-` takes
    terms out again; `- 1` or `+ 0` leaves the intercept out. `.` is every column but those in `omit`. A named transform may
    hold a column or a SQL expression of columns; odd names stand in backticks. Text and booleans are coded by treatment,
    their least level the baseline; levels are read from df, once a column. Terms of fewer factors come first. What can't be
    read, and a term that is no column, raises and is named.
    """
    types, coded = dict(df.dtypes), {}
    reader = _Formula(right, [c for c in df.columns if c not in omit])
    terms, said = reader.sum("") if right.strip() else ([], None)
    for f in dict.fromkeys(f for t in terms for f in t):
        call = re.fullmatch(r"(\w+)\s*\((.+)\)", f, re.S)
        if f in types:
            coded[f] = Transform(f)
            if types[f] in ("string", "boolean"):
                levels = levels_of(df, f)
                coded[f] = OneHot(f, levels, levels[0] if levels else None)
        elif call and call[1] in TRANSFORMS:
            inside = call[2].strip().strip("`") if re.fullmatch(r"\s*(`[^`]+`|\w+)\s*", call[2]) else None
            if inside is not None and inside not in types:
                raise ValueError(f"unknown term of the formula: {f}")
            coded[f] = Computed(call[2].strip(), call[1]) if inside is None else Transform(inside, call[1])
        else:
            raise ValueError(f"unknown term of the formula: {f}")
    ordered = sorted(terms, key=len)
    return Dataset(tuple(interaction([coded[f] for f in t]) for t in ordered), said is not False)


def single_encoders(encoder) -> list:
    """The encoders of single columns inside an encoder, each once; a dummy for missing values counts as one."""
    parts = encoder.encoders if isinstance(encoder, Dataset) else (encoder.a, encoder.b) if isinstance(encoder, Interaction) else ()
    return list(dict.fromkeys(e for p in parts for e in single_encoders(p))) if parts else [encoder]


def predictor_matrix(new: DataFrame, encoder, keep: Sequence[str] = (), unknown: str = "error") -> DataFrame:
    """The design of new rows by an encoder made on others. Rows that miss a value are left out, unless a dummy stands for it.

    unknown: what to do with a level that the encoder doesn't know: "error" fails the job, "drop" leaves the row out.
    """
    for e in single_encoders(encoder):
        x = e.source() if isinstance(e, Computed) else F.col(e.variable)
        if not isinstance(e, MissingDummy):
            new = new.filter(x.isNotNull())
        levels = getattr(getattr(e, "encoder", e), "levels", None)
        if levels:
            known = x.isNull() | x.isin(*levels)
            if unknown == "drop":
                new = new.filter(known)
            else:
                new = new.withColumn(e.variable, F.when(known, x).otherwise(F.raise_error(F.concat(F.lit(f"unknown level of {e.variable}: "), x.cast("string")))))
    return encode(new, encoder, keep)
