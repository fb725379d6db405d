"""Named checks of a table: each gives the rows that fail with sorted codes, or one row of gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordmill.session import checkpoint


def codes(checks: dict[str, Column]) -> Column:
    """The sorted names of the checks that fail for a row, comma-joined; a null counts as a failure."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))), ",")


def violations(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    return rows.select(*key, codes(checks).alias("codes")).where("codes <> ''")


def gates(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: how many rows fail each check, and the status."""
    bad = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()]
    return rows.agg(*bad).withColumn("status", F.when(sum((F.col(n) for n in checks), F.lit(0)) == 0, "pass").otherwise("fail"))


def tolerance(value: Column, expected: Column, limit: Column) -> Column:
    """Whether a value is finite and within the limit of what is expected."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (F.abs(value - expected) <= limit)


def replay(stored: DataFrame, recomputed: DataFrame, key: list[str], value: str, digits: int = 6) -> DataFrame:
    """(key, stored, recomputed, equal) of every key on either side, after rounding."""
    r = lambda c: F.round(c, digits)
    j = stored.select(*key, r(value).alias("stored")).join(recomputed.select(*key, r(value).alias("recomputed")), key, "full_outer")
    return j.withColumn("equal", F.col("stored").eqNullSafe(F.col("recomputed")))


# Which column types stand for a type name of a JSON schema.
SCHEMA_TYPES = {"string": ("string",), "integer": ("tinyint", "smallint", "int", "bigint"), "number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "boolean": ("boolean",), "array": ("array",), "object": ("struct", "map")}


def compiled(schema: dict, rows: DataFrame) -> dict[str, Column]:
    """Checks of a JSON schema over the columns of rows, by name: type:x, required:x, enum:x, const:x, length:x, pattern:x, items:x, and then:x where an
    if/then pair asks for x. A column that isn't there is null everywhere; a null passes what its type list or its absence from required allows.

    Properties, required, and allOf with if (properties with const or enum) and then (required, properties) are understood; anything else raises.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    col = lambda x: F.col(x) if x in kinds else F.lit(None).cast("string")
    checks: dict[str, Column] = {}

    def add(name: str, ok: Column) -> None:
        checks[name] = checks[name] & ok if name in checks else ok

    def of(name: str, rule: dict, when: Column | None = None, prefix: str = "") -> None:
        c = col(name)
        kept = lambda ok: ok if when is None else ~F.coalesce(when, F.lit(False)) | ok
        unknown = set(rule) - {"type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "items", "description", "title"}
        if unknown:
            raise ValueError(f"schema keywords that aren't understood: {sorted(unknown)}")
        if "type" in rule:
            names = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
            fits = name not in kinds or any(kinds[name].simpleString().startswith(t) for n in names if n != "null" for t in SCHEMA_TYPES[n])
            add(f"{prefix}type:{name}", kept(c.isNull() | F.lit(fits)))
        passes = lambda ok: kept(c.isNull() | F.coalesce(ok, F.lit(False)))
        if "enum" in rule:
            add(f"{prefix}enum:{name}", passes(c.isin(*[x for x in rule["enum"] if x is not None])))
        if "const" in rule:
            add(f"{prefix}const:{name}", passes(c == F.lit(rule["const"])))
        if "minLength" in rule or "maxLength" in rule:
            add(f"{prefix}length:{name}", passes((F.length(c.cast("string")) >= rule.get("minLength", 0)) & (F.length(c.cast("string")) <= rule.get("maxLength", 2**31 - 1))))
        if "pattern" in rule:
            add(f"{prefix}pattern:{name}", passes(c.rlike(rule["pattern"])))
        if "minimum" in rule or "maximum" in rule:
            add(f"{prefix}range:{name}", passes((c >= rule.get("minimum", float("-inf"))) & (c <= rule.get("maximum", float("inf")))))
        if "items" in rule and "enum" in rule["items"]:
            add(f"{prefix}items:{name}", passes(F.forall(c, lambda x: x.isin(*rule["items"]["enum"]))))

    for name, rule in schema.get("properties", {}).items():
        of(name, rule)
    for name in schema.get("required", []):
        nullable = "null" in (schema.get("properties", {}).get(name, {}).get("type") or ())
        add(f"required:{name}", F.lit(True) if nullable and name in kinds else col(name).isNotNull())
    for pair in schema.get("allOf", []):
        when = F.lit(True)
        for name, rule in pair["if"]["properties"].items():
            when = when & (col(name).isin(*rule["enum"]) if "enum" in rule else col(name) == F.lit(rule["const"]))
        for name in pair["then"].get("required", []):
            add(f"then:{name}", ~F.coalesce(when, F.lit(False)) | col(name).isNotNull())
        for name, rule in pair["then"].get("properties", {}).items():
            of(name, rule, when, "then:")
    return checks


def ordered_digests(rows: DataFrame, group: str, key: str, width: int = 1000) -> DataFrame:
    """(group, n, sha): a digest of each group's integer keys in order, from digests of digests: keys of one chunk of `width` numbers are hashed, then chunks of chunks, until a group has no more than
    `width`, whose hashes make the last. A group's digest doesn't depend on other groups. So no row ever holds more than `width` of anything, however large a group is."""
    joined = lambda c: F.sha2(F.array_join(c, ","), 256)
    keys = F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string"))
    level = rows.groupBy(group, F.floor(F.col(key) / width).alias("__chunk")).agg(F.count(F.lit(1)).alias("n"), joined(keys).alias("__h"))
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("__chunk", "__h"))), lambda x: x["__h"])
    done = None
    while True:
        level = checkpoint(level)
        sizes = level.groupBy(group).agg(F.count(F.lit(1)).alias("__c")).withColumnRenamed(group, "__g")
        sized = level.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
        last = sized.where(F.col("__c") <= width).groupBy(group).agg(F.sum("n").alias("n"), joined(hashes).alias("sha"))
        done = last if done is None else done.unionByName(last)
        more = checkpoint(sized.where(F.col("__c") > width).select(*level.columns))
        if more.isEmpty():
            return done
        level = more.groupBy(group, F.floor(F.col("__chunk") / width).alias("__next")).agg(F.sum("n").alias("n"), joined(hashes).alias("__h")).withColumnRenamed("__next", "__chunk")
