"""A small algebra of columns over a panel, compiled to Spark (spark.py) or to SQL text (sqltext.py).

A node is a source column, a row-wise function, or a window function. Equal nodes have equal keys, so features that
share a return or a moving average share its column. ``depth`` counts window functions on top of each other: all
windows of one depth are computed side by side. Division, logarithm and square root are null where undefined; no
node yields NaN or infinity from finite numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha1

#: Windows over time within a symbol, and across symbols at one time.
ALONG = frozenset({"lag", "roll", "roll2", "count", "count2", "rownum", "runsum", "runcount", "lastbefore", "lastupto", "blockrun", "blockprev", "pctile", "mad", "values"})
ACROSS = frozenset({"xs", "xsrank"})
WINDOWS = ALONG | ACROSS


@dataclass(frozen=True, eq=False)
class Node:
    op: str
    args: tuple[Node, ...] = ()
    params: tuple = ()
    key: str = field(init=False)
    depth: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "key", sha1(repr((self.op, self.params, [a.key for a in self.args])).encode()).hexdigest()[:16])
        object.__setattr__(self, "depth", max((a.depth for a in self.args), default=0) + (self.op in WINDOWS))

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return isinstance(other, Node) and self.key == other.key

    def __add__(self, other):
        return fn("add", self, other)

    def __radd__(self, other):
        return fn("add", other, self)

    def __sub__(self, other):
        return fn("sub", self, other)

    def __rsub__(self, other):
        return fn("sub", other, self)

    def __mul__(self, other):
        return fn("mul", self, other)

    def __rmul__(self, other):
        return fn("mul", other, self)

    def __truediv__(self, other):
        return fn("div", self, other)

    def __rtruediv__(self, other):
        return fn("div", other, self)

    def __neg__(self):
        return fn("sub", 0.0, self)

    def __lt__(self, other):
        return fn("lt", self, other)

    def __le__(self, other):
        return fn("le", self, other)

    def __gt__(self, other):
        return fn("lt", other, self)

    def __ge__(self, other):
        return fn("le", other, self)

    def __and__(self, other):
        return fn("and", self, other)

    def __or__(self, other):
        return fn("or", self, other)

    def is_(self, other):
        return fn("eq", self, other)

    def is_null(self):
        return fn("isnull", self)

    def known(self):
        return fn("known", self)


def node(x) -> Node:
    return x if isinstance(x, Node) else Node("lit", params=(x,))


def fn(name: str, *args) -> Node:
    return Node(name, tuple(map(node, args)))


def src(column: str) -> Node:
    return Node("src", params=(column,))


NULL = Node("lit", params=(None,))


def when(condition, then, otherwise=NULL) -> Node:
    return fn("when", condition, then, otherwise)


def ln(x) -> Node:
    return fn("ln", x)


def sqrt(x) -> Node:
    return fn("sqrt", x)


def exp(x) -> Node:
    return fn("exp", x)


def absolute(x) -> Node:
    return fn("abs", x)


def sign(x) -> Node:
    return fn("sign", x)


def largest(*xs) -> Node:
    """Skips nulls."""
    return fn("greatest", *xs)


def smallest(*xs) -> Node:
    return fn("least", *xs)


def at_least(x: Node, low) -> Node:
    """Clips from below; null stays null."""
    return when(node(x) < low, low, x)


def at_most(x: Node, high) -> Node:
    return when(node(x) > high, high, x)


def lag(x: Node, k: int = 1) -> Node:
    return Node("lag", (x,), (k,))


def rolling(what: str, x: Node, n: int) -> Node:
    """avg, sum, min, max, stddev_samp, stddev_pop, var_samp, var_pop, skew or kurt of the last n rows, all non-null."""
    return when(Node("count", (x,), (n,)).is_(n), Node("roll", (x,), (what, n)))


def covariance(x: Node, y: Node, n: int) -> Node:
    """Population covariance over the last n rows, all non-null in both."""
    if x == y:
        return rolling("var_pop", x, n)
    return when(Node("count2", (x, y), (n,)).is_(n), Node("roll2", (x, y), ("covar_pop", n)))


def slope(x: Node, y: Node, n: int) -> Node:
    """Least-squares slope of y on x."""
    return covariance(x, y, n) / rolling("var_pop", x, n)


def correlation(x: Node, y: Node, n: int) -> Node:
    both = covariance(x, x, n) * covariance(y, y, n)
    return covariance(x, y, n) / sqrt(both)


def row_number() -> Node:
    return Node("rownum")


def after(x: Node, rows: int) -> Node:
    """Null on a symbol's first rows - 1 rows."""
    return when(row_number() >= rows, x)


def log_return(c: Node, k: int = 1) -> Node:
    return ln(c / lag(c, k))


#: Decay within a block of the exponential scan, as a power of e: sums stay within e**40 of each other.
BLOCK = 40.0
#: Decay after a run of nulls counts as this at most; the past is then gone at double precision anyway.
FORGOTTEN = 300.0


def ewm(x: Node, alpha: float, min_samples: int = 1) -> Node:
    """Exponentially weighted mean: y = (1 - alpha) y' + alpha x, seeded by the first value, null where x is null.

    Weights count absolute rows: after g nulls the past keeps (1 - alpha)**(g + 1) against alpha. In closed form
    y_t = exp(-L_t) * sum of w_i x_i exp(L_i), with L the running sum of -ln of what the past keeps. Sums are taken
    by blocks of BLOCK in L, which the block before (and the one before that) enter as a whole: older ones weigh less than exp(-BLOCK * 2),
    beyond double precision. So it is all window functions, without a join and in linear time.
    """
    import math

    known = x.known()
    number = row_number()
    before = Node("lastbefore", (when(known, number),))
    kept = (number - before) * -math.log1p(-alpha)  # -ln (1 - alpha)**(g + 1)
    past = exp(-at_most(kept, FORGOTTEN))
    first = before.is_null()
    loss = when(known, when(first, 0.0, at_most(-ln(past / (past + alpha)), FORGOTTEN)), 0.0)
    weight = when(first, 1.0, alpha / (past + alpha))
    total = Node("runsum", (loss,))
    block = fn("floor", total / BLOCK)
    term = when(known, weight * x * exp(total - block * BLOCK))
    run = Node("blockrun", (term, block))
    carried = sum((fn("or0", Node("blockprev", (term, block), (d,))) * math.exp(-BLOCK * d) for d in (1, 2)), start=fn("or0", run))
    return when(known & (Node("runcount", (x,)) >= min_samples), carried * exp(block * BLOCK - total))


def across(what: str, x: Node) -> Node:
    """avg, stddev_samp or count of x over all symbols at one time."""
    return Node("xs", (x,), (what,))


def rank_across(x: Node) -> Node:
    """Average rank over the count of known values, in (0, 1]; null stays null."""
    return when(x.known(), Node("xsrank", (x,)) / across("count", x))


def zscore_across(x: Node, winsorize: float | None = None) -> Node:
    if winsorize is not None:
        m, s = across("avg", x), across("stddev_samp", x) * winsorize
        x = at_most(at_least(x, m - s), m + s)
    return (x - across("avg", x)) / across("stddev_samp", x)
