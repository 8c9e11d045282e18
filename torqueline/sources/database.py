"""Tables of a relational database, read in parts of even size."""

from pyspark.sql import DataFrame, SparkSession

#: Ranges of keys that the database counts rows in at once.
RANGES = 1024


def key_ranges(spark: SparkSession, url: str, table: str, key: str, rows: int, properties: dict[str, str]) -> list[tuple[int, int]]:
    """Ranges (from, to) of the whole-number ``key`` that hold about ``rows`` rows each, counted by the database.

    Rows are counted in equal ranges between the smallest and largest key; one that holds more is counted again in narrower ones, so
    keys that lie close together do not make one large part. A single key is never divided."""
    ask = lambda sql: spark.read.jdbc(url, f"({sql}) q", properties=properties).collect()  # noqa: E731  RANGES rows at most
    low, high = ask(f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}")[0]
    if low is None:
        return []
    counted: list[tuple[int, int, int]] = []
    todo = [(int(low), int(high))]
    while todo:
        first, last = todo.pop()
        width = -(-(last - first + 1) // RANGES)
        sql = f"SELECT ({key} - {first}) / {width} AS part, COUNT(*) AS n FROM {table} WHERE {key} BETWEEN {first} AND {last} GROUP BY ({key} - {first}) / {width}"
        for part, n in ask(sql):
            begin = first + int(part) * width
            end = min(begin + width - 1, last)
            if n > rows and end > begin:
                todo.append((begin, end))
            else:
                counted.append((begin, end, int(n)))
    out: list[tuple[int, int]] = []
    held = 0
    for begin, end, n in sorted(counted):
        if out and held + n <= rows:
            out[-1], held = (out[-1][0], end), held + n
        else:
            out.append((begin, end))
            held = n
    return out


def database_table(spark: SparkSession, url: str, table: str, key: str, rows=1_000_000, properties: dict[str, str] | None = None) -> DataFrame:
    """A table read over JDBC in parts of about ``rows`` rows by its whole-number ``key``; rows without a key are a part of their own.

    Filters and columns that are asked for go to the database. Parts are read by queries of their own, so rows that are written
    in between can be in a part and not in the counts: ranges have no gaps and the first and last are open."""
    properties = properties or {}
    ranges = key_ranges(spark, url, table, key, rows, properties)
    starts = [begin for begin, _ in ranges][1:]
    bounds = [None, *starts, None]
    parts = [f"{key} IS NULL"]
    for begin, end in zip(bounds, bounds[1:], strict=False):
        known = [f"{key} >= {begin}"] * (begin is not None) + [f"{key} < {end}"] * (end is not None)
        parts.append(" AND ".join(known) or f"{key} IS NOT NULL")
    return spark.read.jdbc(url, table, predicates=parts, properties=properties)
