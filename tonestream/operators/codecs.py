"""Codec analysis: prediction residuals and their coding costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.bits import zigzag



def ordered() -> WindowSpec:
    return Window.partitionBy("sid").orderBy("idx")


#: Binomial coefficients with alternating signs: finite differences of orders 0 to 4.
DIFFERENCES = [[1], [1, -1], [1, -2, 1], [1, -3, 3, -1], [1, -4, 6, -4, 1]]


def fixed_residual(v: str, order: int) -> Column:
    """The order-th difference; null for the warm-up samples."""
    parts = [F.lag(v, k).over(ordered()) * c if k else F.col(v) * c for k, c in enumerate(DIFFERENCES[order])]
    return sum(parts[1:], parts[0])


def residuals(df: DataFrame, v: str = "q") -> DataFrame:
    return df.select("*", *[fixed_residual(v, k).alias(f"r{k}") for k in range(5)])


def best_fixed_order(df: DataFrame, v: str = "q") -> DataFrame:
    """Per stream the order with the least sum of folded residuals behind the fourth
    sample, sampled with a stride beyond 512 samples; the lower order wins ties."""
    sized = df.join(df.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), "sid")
    stride = F.greatest(F.lit(1), F.floor((F.col("n") - 4) / 512))
    r = residuals(sized, v).withColumn("stride", stride).filter("idx >= 4 and (idx - 4) % stride = 0")
    cost = r.groupBy("sid").agg(*[F.sum(zigzag(F.col(f"r{k}"))).alias(f"c{k}") for k in range(5)])
    pairs = cost.select("sid", F.explode(F.array(*[F.struct(F.col(f"c{k}").alias("cost"), F.lit(k).alias("fixed_order")) for k in range(5)])).alias("p"))
    return pairs.groupBy("sid").agg(F.min("p").alias("p")).select("sid", "p.fixed_order", "p.cost")


def restore_first(df: DataFrame, r: str = "r") -> DataFrame:
    """Order 1 undone: a running sum, exact for integers."""
    return df.withColumn("q", F.sum(r).over(ordered()))


def mid_side(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.withColumns({"mid": F.shiftright(F.col(left) + F.col(right), 1), "side": F.col(left) - F.col(right)})


def from_mid_side(df: DataFrame) -> DataFrame:
    total = F.col("mid") * 2 + F.abs("side") % 2
    return df.withColumns({"left_": F.shiftright(total + F.col("side"), 1), "right_": F.shiftright(total - F.col("side"), 1)})


def rice_costs(df: DataFrame, groups: list[str], folded: str, bits: int = 4) -> DataFrame:
    """Per group and parameter k: parameter bits, a unary stop and k bits a value, and
    the quotients."""
    most = (1 << bits) - 2
    sums = [F.sum(F.shiftright(folded, k)).alias(f"s{k}") for k in range(most + 1)]
    t = df.groupBy(*groups).agg(F.count(folded).alias("n"), *sums)
    each = [F.struct((F.lit(bits) + F.col("n") * (k + 1) + F.col(f"s{k}")).alias("cost"), F.lit(k).alias("k")) for k in range(most + 1)]
    return t.select(*groups, "n", F.explode(F.array(*each)).alias("p")).select(*groups, "n", "p.cost", "p.k")


def rice_parameter(df: DataFrame, groups: list[str], folded: str, bits: int = 4) -> DataFrame:
    """The cheapest k, the lower one of ties."""
    best = rice_costs(df, groups, folded, bits).groupBy(*groups).agg(F.min(F.struct("cost", "k")).alias("p"))
    return best.select(*groups, "p.cost", "p.k")


def rice_partition_order(df: DataFrame, folded: str, deepest: int = 3, size: int = 32) -> DataFrame:
    """Per stream and block of `size` values: of 2**p parts the p of least cost."""
    rows = df.withColumns({"block": F.floor(F.col("idx") / size), "order_": F.explode(F.sequence(F.lit(0), F.lit(deepest)))})
    rows = rows.withColumn("part", F.expr(f"(idx % {size}) div ({size} div shiftleft(1, order_))"))
    cost = rice_parameter(rows, ["sid", "block", "order_", "part"], folded).groupBy("sid", "block", F.col("order_").alias("p")).agg(F.sum("cost").alias("cost"))
    return cost.groupBy("sid", "block").agg(F.min(F.struct("cost", "p")).alias("b")).select("sid", "block", "b.cost", F.col("b.p").alias("partition_order"))


def autocorrelation(df: DataFrame, most: int) -> DataFrame:
    return df.select("sid", *[(F.col("v") * F.lag("v", k).over(ordered()) if k else F.col("v") * F.col("v")).alias(f"p{k}") for k in range(most + 1)]).groupBy("sid").agg(*[F.sum(f"p{k}").alias(f"lag{k}") for k in range(most + 1)])


def tukey(idx: Column, n: Column, p: float) -> Column:
    """Raised cosine over int(p / 2 * n) - 1 samples at either end."""
    taper = F.floor(F.lit(p / 2) * n) - 1
    rise = lambda i: 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * i / taper)
    return F.when(taper <= 0, F.lit(1.0)).when(idx < taper, rise(idx)).when(idx > n - 1 - taper, rise(n - 1 - idx)).otherwise(F.lit(1.0))


def levinson(lags: list[float], order: int) -> list[float]:
    """Prediction coefficients; stops where a reflection reaches 0.999999."""
    a: list[float] = []
    error = lags[0]
    for i in range(order):
        if error <= 0:
            break
        k = (lags[i + 1] - sum(c * lags[i - j] for j, c in enumerate(a))) / error
        if abs(k) >= 0.999999:
            break
        a = [c - k * a[i - 1 - j] for j, c in enumerate(a)] + [k]
        error *= 1 - k * k
    return a


def rechunk(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns({"block": F.floor(F.col("idx") / size), "place": F.col("idx") % size})


def packetize(df: DataFrame, data: str, size: int) -> DataFrame:
    """Binary rows in pieces of `size` bytes: seq, pts, data."""
    n = F.octet_length(data)
    rows = df.filter(n > 0).withColumn("seq", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size))))
    return rows.withColumns({"pts": F.col("seq") * size, "piece": F.substring(F.col(data), F.col("seq").cast("int") * size + 1, F.lit(size))})
