"""Types from text: labels, guarded conversions, and casts that a measure of the whole frame decides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words for true and false, currency marks, name parts that hint at a time, formats of times.
TRUE_WORDS = ("true", "yes", "y", "t", "1", "on")
FALSE_WORDS = ("false", "no", "n", "f", "0", "off")
CURRENCY = r"[$€£¥₹,\s]"
TIME_HINTS = ("date", "time", "timestamp", "_at", "created", "updated")
TIME_FORMATS = (
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", "yyyy-MM-dd HH:mm"),
    (r"\d{14}", "yyyyMMddHHmmss"),
    (r"\d{12}", "yyyyMMddHHmm"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
    (r"\d{4}\.\d{2}\.\d{2}", "yyyy.MM.dd"),
    (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"),
    (r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}", "yyyy/MM/dd HH:mm"),
    (r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}", "dd/MM/yyyy HH:mm"),
)
LABELS = (
    ("timestamp", r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}"),
    ("date", r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"),
    ("boolean", r"true|false|yes|no|y|n"),
    ("integer", r"-?\d+"),
    ("float", r"-?\d*\.?\d+|-?\d*\.?\d*[eE][+-]?\d+"),
)
OLDER_LABELS = (
    ("timestamp", r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}|\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}|\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}"),
    ("date", r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2}|\d{2}-\d{2}-\d{4}"),
    ("time", r"\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2}\.\d+|\d{2}:\d{2}"),
    ("duration", r"\d+:\d{2}:\d{2}|\d+\s*(hours?|hrs?|h)\s*\d*\s*(minutes?|mins?|m)?|\d+\s*days?\s*\d*:\d{2}:\d{2}"),
    ("boolean", r"true|false|yes|no|y|n|t|f"),
    ("binary", r"[01]"),
    ("integer", r"-?\d+"),
    ("float", r"-?\d*\.?\d+|-?\d*\.?\d*[eE][+-]?\d+"),
)

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# ---------------------------------------------------------------- guarded conversions (null where they fail)


def to_number(c: Column) -> Column:
    """Decimal text to double; what Spark's cast takes beyond that (1d, inf, nan, hexadecimal) is null."""
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def to_currency(c: Column) -> Column:
    """A number without its currency marks, thousands commas and spaces."""
    return to_number(F.regexp_replace(c.cast("string"), CURRENCY, ""))


def to_whole(c: Column) -> Column:
    """A whole number without its currency marks, thousands commas and spaces."""
    return to_integer(F.regexp_replace(c.cast("string"), CURRENCY, ""))


def to_boolean(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def to_integer(c: Column, bits: int = 64) -> Column:
    """Whole numbers within the width; text goes through an exact decimal, so that no digit of a long is lost."""
    s = F.trim(c.cast("string"))
    plain = F.when(s.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(s, r"\..*$", "").try_cast("decimal(38,0)"))
    n = to_number(s)
    other = F.when(F.abs(n - F.round(n)) <= 1e-9, F.round(n).try_cast("decimal(38,0)"))
    whole = F.coalesce(plain, other)
    return F.when(whole.between(F.lit(-(2 ** (bits - 1))).cast("decimal(38,0)"), F.lit(2 ** (bits - 1) - 1).cast("decimal(38,0)")), whole.try_cast("bigint"))


def to_time(c: Column, dayfirst: bool = True) -> Column:
    """The first format that the whole text has decides; days come before months where dayfirst."""
    s = F.trim(c.cast("string"))
    # all formats begin with a digit and have 8 characters or more; other text meets none of the patterns
    s = F.when((F.length(s) >= 8) & F.substring(s, 1, 1).between("0", "9"), s)
    out = None
    for shape, form in TIME_FORMATS:
        form = form if dayfirst else form.replace("dd/MM", "MM/dd")
        text = F.regexp_replace(F.replace(s, F.lit("T"), F.lit(" ")), r"\s+", " ")
        parsed = F.try_to_timestamp(F.when(s.rlike(f"^(?:{shape})$"), text), F.lit(form)).cast("timestamp_ntz")
        out = parsed if out is None else F.coalesce(out, parsed)
    return out


def to_seconds(c: Column) -> Column:
    """Durations as seconds: [D days] H:MM:SS, or hours and minutes in words."""
    s = F.lower(F.trim(c.cast("string")))
    clock, words = r"^(?:(\d+)\s*days?\s*)?(\d+):(\d{2}):(\d{2})$", r"^(\d+)\s*(?:hours?|hrs?|h)\s*(?:(\d+)\s*(?:minutes?|mins?|m)?)?$"
    part = lambda p, k: F.coalesce(F.nullif(F.regexp_extract(s, p, k), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(s.rlike(clock), part(clock, 1) * 86400 + part(clock, 2) * 3600 + part(clock, 3) * 60 + part(clock, 4)).when(s.rlike(words), part(words, 1) * 3600 + part(words, 2) * 60)


def parse_json(c: Column) -> Column:
    """A text as a variant, null where it is not one JSON value and nothing else.

    The parser stops behind the first value and passes over what follows. Text is one value only if it is valid both as
    an array's one element and as an object's one member: no rest is.
    """
    s = c.cast("string")
    alone = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(s))


def to_json_text(c: Column) -> Column:
    """Compact JSON with sorted keys; null where the text is none."""
    return F.to_json(parse_json(c))


def is_structured(c: Column) -> Column:
    """Text in braces or brackets that is JSON; null stays null."""
    s = F.trim(c.cast("string"))
    framed = s.rlike(r"(?s)^(\{.*\}|\[.*\])$")
    return F.when(c.isNotNull(), F.coalesce(framed & parse_json(F.when(framed, s)).isNotNull(), F.lit(False)))


def _parsed(dayfirst: bool):
    """An Arrow function for times of any form; nested, it travels by value."""

    @F.pandas_udf(T.TimestampNTZType())
    def parse(s):
        import pandas as pd
        from dateutil import parser

        def one(text):
            try:
                return parser.parse(text, dayfirst=dayfirst).replace(tzinfo=None) if text and text.strip() else None
            except (ValueError, OverflowError):
                return None

        return pd.to_datetime(s.map(one, na_action="ignore"), errors="coerce")

    return parse


def to_time_free(c: Column, dayfirst: bool = True, to_minutes: bool = True) -> Column:
    """A time by the fixed formats, or else of any form that says one ("2 Jan 1995 3 pm"); cut to minutes.

    Only texts with a digit that no fixed format fits leave the JVM.
    """
    fixed, s = to_time(c, dayfirst), c.cast("string")
    rest = F.when(fixed.isNull() & s.rlike(r"\d"), s)
    out = F.coalesce(fixed, _parsed(dayfirst)(rest))
    return F.date_trunc("minute", out).cast("timestamp_ntz") if to_minutes else out


def to_clock(c: Column) -> Column:
    """A time of day as HH:mm:ss text, with or without seconds and am or pm; null where it is none."""
    s = F.upper(F.trim(c.cast("string")))
    found = None
    for pattern, form in ((r"^\d{1,2}:\d{2}:\d{2}$", "H:mm:ss"), (r"^\d{1,2}:\d{2}$", "H:mm"), (r"^\d{1,2}:\d{2}:\d{2} ?[AP]M$", "h:mm:ss a"), (r"^\d{1,2}:\d{2} ?[AP]M$", "h:mm a")):
        text = F.regexp_replace(s, r" ?([AP]M)$", " $1")
        one = F.try_to_timestamp(F.when(s.rlike(pattern), text), F.lit(form))
        found = one if found is None else F.coalesce(found, one)
    return F.date_format(found, "HH:mm:ss")


def to_bits(c: Column) -> Column:
    """0 or 1 as a boolean; null for anything else."""
    s = F.trim(c.cast("string"))
    return F.when(s == "1", True).when(s == "0", False)


CONVERSIONS = {"integer": to_integer, "float": to_number, "boolean": to_boolean, "timestamp": to_time, "date": lambda c: to_time(c).cast("date"), "duration": to_seconds, "currency": to_currency, "whole": to_whole, "time": to_clock, "binary": to_bits}


# ---------------------------------------------------------------- labels


def label(c: Column, labels=LABELS) -> Column:
    """The first kind whose pattern the whole (trimmed) text has, else string; null and empty text have none."""
    s = F.trim(c.cast("string"))
    out = None
    for name, pattern in labels:
        hit = s.rlike(f"^(?i:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(s != "", out.otherwise("string"))


def measure_labels(df: DataFrame, columns: list[str] | None = None, labels=LABELS) -> dict[str, dict[str, int]]:
    """How many values of each text column have which label: one aggregation for all columns."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    names = [n for n, _ in labels] + ["string"]
    if not columns:
        return {}
    tagged = df.select(*[label(F.col(f"`{c}`"), labels).alias(f"c{k}") for k, c in enumerate(columns)])
    row = tagged.agg(*[F.count_if(F.col(f"c{k}") == n).alias(f"c{k}_{n}") for k in range(len(columns)) for n in names]).first()
    return {c: {n: row[f"c{k}_{n}"] for n in names} for k, c in enumerate(columns)}


def infer(counts: dict[str, int], threshold: float = 0.9, enough: float = 0.7) -> tuple[str, float]:
    """(label, confidence): the commonest one if it reaches the threshold, or is more than enough, else string."""
    total = sum(counts.values())
    if not total:
        return "string", 0.0
    name = max(counts, key=counts.get)
    share = counts[name] / total
    return (name, share) if share >= threshold or share > enough else ("string", share)


# The shares of a value's characters that tell its kind where no pattern does.
MOSTLY_DIGITS, HALF_DIGITS, FEW_LETTERS, SOME_SEPARATORS = 0.8, 0.5, 0.2, 0.1


def composition(c: Column) -> Column:
    """What a value is made of: word (is it one for true or false), day (does it begin with an ISO day), number (is it one,
    currency marks aside), and the shares of digits, letters, date separators and points."""
    text = F.trim(c.cast("string"))
    plain = F.regexp_replace(F.lower(text), CURRENCY, "")
    mantissa = F.regexp_replace(plain, r"e[+-]?[0-9]+", "")

    def share(of: Column, kind: str) -> Column:
        return F.regexp_count(of, F.lit(kind)) / F.greatest(F.length(of), F.lit(1))

    return F.struct(
        F.lower(text).isin(*TRUE_WORDS, *FALSE_WORDS).alias("word"),
        text.rlike(r"^\d{4}-\d{2}-\d{2}").alias("day"),
        plain.rlike(r"^-?\d*\.?\d+(e[-+]?\d+)?$").alias("number"),
        share(mantissa, r"(?U)\d").alias("digits"),
        share(mantissa, r"\p{L}").alias("letters"),
        share(plain, "[/:-]").alias("separators"),
        share(plain, r"\.").alias("points"),
    )


def _kind_of(m: Column) -> Column:
    digits, few = m["digits"] > MOSTLY_DIGITS, m["letters"] < FEW_LETTERS
    # digits with a point are a number, and without one a count, unless letters stand among them
    numeric = F.when(m["points"] > 0, "float").when(few, "integer")
    dated = F.when((m["separators"] > SOME_SEPARATORS) & (m["digits"] > HALF_DIGITS) & few, "datetime")
    by_pattern = F.when(m["word"], "boolean").when(m["day"], "datetime").when(m["number"], "float")
    return F.coalesce(by_pattern, F.when(digits, numeric), dated, F.lit("object"))


def shape_label(c: Column) -> Column:
    """boolean, datetime, float, integer or object, by a value's pattern or else by what it is made of. Plain whole numbers
    match the pattern of numbers and so are float; null has no label."""
    # measured once for each value, as the lambda's argument
    return F.when(c.isNotNull(), F.get(F.transform(F.array(composition(c)), _kind_of), 0))


def plan_by_shape(df: DataFrame, columns: list[str] | None = None) -> CastPlan:
    """Each text column gets the conversion of its commonest shape, counted over all rows in one aggregation; the first
    label by name among equally common ones."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return CastPlan()
    shapes = ("boolean", "datetime", "float", "integer", "object")
    counts = [F.count_if(shape_label(F.col(f"`{c}`")) == s).alias(f"{k}_{s}") for k, c in enumerate(columns) for s in shapes]
    row = df.agg(*counts).first()
    plan = CastPlan()
    for k, c in enumerate(columns):
        found = {s: row[f"{k}_{s}"] for s in shapes if row[f"{k}_{s}"]}
        common = max(found, key=found.get, default="object")
        if common != "object":
            plan.conversions[c] = "timestamp" if common == "datetime" else common
            plan.measured[c] = found[common] / sum(found.values())
    return plan


# ---------------------------------------------------------------- casts of frames


@dataclass(frozen=True)
class CastConfig:
    use_transform: bool = True
    infer_threshold: float = 0.9
    max_null_increase: float = 0.1
    dayfirst: bool = True
    labels: tuple = LABELS


@dataclass(frozen=True)
class CastPlan:
    """Which conversion each text column gets. `measured` is the share of values that it keeps."""

    conversions: dict[str, str] = field(default_factory=dict)
    semantic: dict[str, str] = field(default_factory=dict)
    measured: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: CONVERSIONS[k](F.col(f"`{c}`")) for c, k in self.conversions.items() if c in df.columns})


def plan_cast(df: DataFrame, config: CastConfig = CastConfig(), dtypes: dict[str, str] | None = None) -> CastPlan:
    """Measure all text columns in one aggregation and decide on their conversions.

    With use_transform: a name that hints at a time (unless the column is JSON), then numbers, then booleans; columns in
    dtypes are left as they are. Else: by label, then as numbers, then as times; dtypes name a column's conversion.
    A conversion that makes more than max_null_increase of the values null is not made.
    """
    dtypes = dtypes or {}
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return CastPlan()
    exprs = []
    for k, c in enumerate(text):
        v = F.col(f"`{c}`")
        full = v.isNotNull() & (F.trim(v) != "")
        exprs += [F.count(v).alias(f"n{k}"), F.count_if(full).alias(f"f{k}"), F.count_if(F.coalesce(is_structured(v), F.lit(False))).alias(f"j{k}")]
        # only what may decide on this column
        if config.use_transform:
            asked = () if c in dtypes else ("timestamp",) if any(h in c.lower() for h in TIME_HINTS) else ("currency", "whole", "boolean")
        else:
            asked = (dtypes[c],) if dtypes.get(c) in CONVERSIONS else () if c in dtypes else tuple(n for n, _ in config.labels if n in CONVERSIONS)
            if c not in dtypes:
                exprs += [F.count_if(label(v, config.labels) == name).alias(f"l_{name}{k}") for name in [n for n, _ in config.labels] + ["string"]]
        exprs += [F.count_if(CONVERSIONS[name](v).isNotNull()).alias(f"{name}{k}") for name in asked]
    row = df.agg(*exprs).first()
    chosen, semantic, kept = {}, {}, {}
    for k, c in enumerate(text):
        n, full = row[f"n{k}"], row[f"f{k}"]
        share = lambda name: row[f"{name}{k}"] / n if n else 0.0  # noqa: B023, E731
        semantic[c] = "STRUCTURED_OBJECT" if n and row[f"j{k}"] / n >= config.infer_threshold else "STRING_OBJECT"
        pick = None
        if config.use_transform:
            if c in dtypes or not n:
                continue
            if any(h in c.lower() for h in TIME_HINTS):
                pick = "timestamp" if row[f"j{k}"] / n < 0.9 else None
            elif share("currency") > 0.9:
                # whole numbers only where all are
                pick = "whole" if share("whole") == share("currency") else "currency"
            elif share("boolean") >= 0.9:
                pick = "boolean"
        elif c in dtypes:
            pick = dtypes[c] if dtypes[c] in CONVERSIONS else None
        elif full:
            name, _ = infer({n_: row[f"l_{n_}{k}"] for n_ in [x for x, _ in config.labels] + ["string"]}, config.infer_threshold)
            pick = name if name in CONVERSIONS else "float" if share("float") >= config.infer_threshold else "timestamp" if share("timestamp") >= config.infer_threshold else None
        if pick and (c in dtypes or pick == "boolean" and config.use_transform or 1 - share(pick) <= config.max_null_increase):
            chosen[c], kept[c] = pick, share(pick)
    return CastPlan(chosen, semantic, kept)


def cast(df: DataFrame, config: CastConfig = CastConfig(), dtypes: dict[str, str] | None = None) -> DataFrame:
    return plan_cast(df, config, dtypes).apply(df)


# Names of types, as pandas, numpy and SQL spell them, and the kinds that they mean.
KIND_NAMES = {
    "int": "integer", "int8": "integer", "int16": "integer", "int32": "integer", "int64": "integer", "integer": "integer", "bigint": "integer", "long": "integer",
    "float": "float", "float32": "float", "float64": "float", "double": "float", "number": "float",
    "bool": "boolean", "boolean": "boolean", "datetime": "timestamp", "datetime64[ns]": "timestamp", "timestamp": "timestamp", "date": "date",
    "str": "string", "string": "string", "object": "string", "category": "string", "timedelta": "duration", "timedelta64[ns]": "duration",
}


def kind_name(name: str) -> str:
    """The kind that a type's name means, in any case; a name that isn't known is an error."""
    kind = KIND_NAMES.get(name.strip().lower())
    if kind is None:
        raise ValueError(f"{name!r} is no type's name")
    return kind


def safe_astype(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Columns as the kinds that names mean; what doesn't fit becomes null, or with strict is an error that counts it."""
    made = {c: F.col(f"`{c}`").cast("string") if kind_name(n) == "string" else CONVERSIONS[kind_name(n)](F.col(f"`{c}`")) for c, n in types.items()}
    if strict and made:
        row = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & x.isNull()).alias(c) for c, x in made.items()]).first().asDict()
        if bad := {c: n for c, n in row.items() if n}:
            raise ValueError("; ".join(f"{c}: {n} values are no {types[c]}" for c, n in bad.items()))
    return df.withColumns(made)


def auto_cast(df: DataFrame) -> DataFrame:
    return cast(df, CastConfig(use_transform=False))


def fast_cast(df: DataFrame) -> DataFrame:
    return cast(df, CastConfig())


def safe_cast(df: DataFrame) -> DataFrame:
    return cast(df, CastConfig(use_transform=False, infer_threshold=0.95, max_null_increase=0.05))
