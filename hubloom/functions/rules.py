"""Column expressions of the scoring domain. All run in the JVM; nulls and NaN are no values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hubloom.functions import settings as S


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def lookup(table: Mapping[str, object], key: Column, default: object = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def first_contained(text: Column, weights: Mapping[str, float], default: float) -> Column:
    """The weight of the first key, in the table's order, that the text holds whatever its case."""
    low = F.lower(F.trim(text))
    out = None
    for key, w in weights.items():
        hit = low.contains(key.lower())
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return F.when(text.isNull(), default).otherwise(out.otherwise(default))


def members(modes: Column, of: Iterable[str]) -> Column:
    of = list(of)
    return F.filter(modes, lambda m: m.isin(of))


def count_members(modes: Column, of: Iterable[str] = S.MASS_TRANSIT) -> Column:
    """How many entries are in the set, repeats counted; 0 for a null list."""
    return F.coalesce(F.size(members(modes, of)), F.lit(0)) if modes is not None else F.lit(0)


def any_member(modes: Column, of: Iterable[str]) -> Column:
    of = list(of)
    return F.coalesce(F.exists(modes, lambda m: m.isin(of)), F.lit(False))


def only_members(modes: Column, within: Iterable[str], of: Iterable[str]) -> Column:
    """Whether those of `within` are not none and all in `of`."""
    of = list(of)
    mine = members(modes, within)
    return F.coalesce((F.size(mine) > 0) & F.forall(mine, lambda m: m.isin(of)), F.lit(False))


def tier_from_ridership(demand: Column) -> Column:
    high, mid = S.TIER_DEMAND
    d = no_nan(demand)
    return F.when(d >= high, S.NATIONAL).when(d >= mid, S.METROPOLITAN).otherwise(S.LOCAL)


def tier(modes: Column, lines: Column, demand: Column, metro_min: float | None = None) -> Column:
    """The ladder of tiers by modes, lines and demand; metro_min: least demand of the second rung."""
    has = {name: any_member(modes, names) for name, names in {
        "hsr": ("HighSpeed Rail", "HighSpeed"), "int": ("Interurban Rail", "Interurban"), "sub": ("Suburban Rail", "Suburban"),
        "rail": ("Rail",), "metro": ("Metro",), "local": ("BRT", "LRT"),
    }.items()}
    n, d = F.coalesce(lines, F.lit(0)), F.coalesce(no_nan(demand), F.lit(0.0))
    many = n >= 3
    rail = has["hsr"] | has["int"] | has["sub"] | has["rail"]
    second = (rail | has["metro"]) & many
    if metro_min is not None:
        second = second & (d >= metro_min)
    return (
        F.when((has["hsr"] | has["int"] | has["rail"]) & many & (d >= S.TIER_DEMAND[0]), S.NATIONAL)
        .when(second, S.METROPOLITAN)
        .when(has["local"] & many & (d >= S.MIN_PASSENGERS), S.LOCAL)
        .when(rail & (n <= 2), "Train Station")
        .otherwise("Not Hub")
    )


def former_tier(modes: Column, lines: Column, demand: Column) -> Column:
    """The former ladder under its English names; generic rail is no rail there."""
    n, d = F.coalesce(lines, F.lit(0)), F.coalesce(no_nan(demand), F.lit(0.0))
    fast, rail = any_member(modes, ("HighSpeed Rail", "Interurban Rail")), any_member(modes, ("HighSpeed Rail", "Interurban Rail", "Suburban Rail"))
    return (
        F.when(fast & (n >= 3) & (d >= S.TIER_DEMAND[0]), "National")
        .when((rail | any_member(modes, ("Metro",))) & (n >= 3), "Regional")
        .when(any_member(modes, ("BRT", "LRT")) & (n >= 3) & (d >= S.MIN_PASSENGERS), "Local")
        .when(rail & (n <= 2), "Train Station")
        .otherwise("Not Hub")
    )


def corrected_modes(modes: Column) -> Column:
    """Short rail names made long; generic rail dropped; none for a null list."""
    long = {"HighSpeed": "HighSpeed Rail", "Interurban": "Interurban Rail", "Suburban": "Suburban Rail"}
    plain = F.transform(modes, lambda m: F.trim(F.replace(m, F.lit(","), F.lit(""))))
    return F.coalesce(F.transform(F.filter(plain, lambda m: m != "Rail"), lambda m: F.coalesce(lookup(long, m), m)), F.array().cast("array<string>"))


def mode_service(modes: Column, lines: Column) -> Column:
    """Weights of the modes times the root of the lines per mode, with a bonus for each mode more."""
    n = F.size(modes)
    per = F.when(lines.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.try_divide(lines.cast("double"), n)))
    weights = F.aggregate(F.transform(modes, lambda m: lookup(S.MODE_WEIGHTS, m, 1.0)), F.lit(0.0), lambda a, w: a + w)
    bonus = F.when(n > 1, 1 + S.DIVERSITY_BONUS * (n - 1)).otherwise(F.lit(1.0))
    return F.when(n > 0, weights * F.sqrt(per) * bonus).otherwise(F.lit(0.0))


def mode_lines(modes: Column, lines: Column) -> dict[str, Column]:
    """The lines dealt evenly to the modes that have a column; an alias takes its mode's place."""
    named = F.transform(modes, lambda m: lookup(S.MODE_ALIASES | {"Rail": "Interurban Rail"}, m))
    named = F.zip_with(named, modes, lambda a, m: F.coalesce(a, m))
    valid = members(named, S.MODE_COLUMNS)
    each = F.try_divide(lines.cast("double"), F.size(valid))
    return {m: F.when(F.array_contains(valid, m), F.coalesce(each, F.lit(0.0))).otherwise(F.lit(0.0)) for m in S.MODE_COLUMNS}


def positive_count(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce((c > 0).cast("int"), F.lit(0)) for c in columns])


def mode_score(columns: Mapping[str, Column]) -> Column:
    """Lines times weights, linear, with the bonus for each mode more."""
    total = reduce(lambda a, b: a + b, [c * S.MODE_WEIGHTS[m] for m, c in columns.items()])
    n = positive_count(columns.values())
    return total * (1 + S.DIVERSITY_BONUS * F.greatest(n - 1, F.lit(0)))


def minmax(v: Column, least: Column, most: Column, low: float = S.SCORE_MIN, high: float = S.SCORE_MAX, clip: bool = True) -> Column:
    """v from least..most to low..high; the middle for every row if nothing differs."""
    scaled = low + (v - least) * (high - low) / F.nullif(most - least, F.lit(0.0))
    if clip:
        scaled = F.when(scaled.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), scaled)))
    return F.when(least == most, F.lit((low + high) / 2)).otherwise(scaled)


def log10_or_zero(v: Column) -> Column:
    return F.log10(F.when(v <= 0, 1.0).otherwise(v))


def ring_weights(midpoints: Iterable[float] = S.RING_MIDPOINTS, decay: float = S.DECAY) -> list[float]:
    raw = [m**-decay for m in midpoints]
    return [r / sum(raw) for r in raw]


def pop_jobs(pop: list[Column], jobs: list[Column], tier_: Column) -> Column:
    share = lookup(S.JOB_SHARE, tier_, S.JOB_SHARE[S.METROPOLITAN])
    parts = [(p * (1 - share) + j * share) * w for p, j, w in zip(pop, jobs, ring_weights())]
    return reduce(lambda a, b: a + b, parts)


def pop_jobs_raw(pop: list[Column], jobs: list[Column], tier_: Column) -> Column:
    """People and jobs over distance to the power of the decay; jobs count most in the two highest tiers, under either name."""
    share = F.when(tier_.isin(S.NATIONAL, S.METROPOLITAN, "National", "Regional"), 0.8).otherwise(0.2)
    parts = [(p * (1 - share) + j * share) / m**S.DECAY for p, j, m in zip(pop, jobs, S.RING_MIDPOINTS)]
    return reduce(lambda a, b: a + b, parts)


def first_model(district: Column, area: Column) -> Column:
    return F.coalesce(F.get(candidate_models(district, area), 0), F.lit("Unknown"))


def candidate_models(district: Column, area: Column) -> Column:
    """The models whose keywords the text of district and area holds, in order, each once."""
    text = F.concat_ws(" ", district, area)
    found = []
    for keys, models in S.CANDIDATE_MODELS:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keys])
        found += [F.when(hit, m) for m in models]
    return F.array_distinct(F.array_compact(F.array(*found)))


def slider_to_saaty(v: Column) -> Column:
    return F.when(v == 0, 1.0).when(v > 0, v + 1.0).otherwise(1.0 / (F.abs(v) + 1.0))


def saaty_to_slider(v: Column) -> Column:
    return F.when(v == 1, 0).when(v > 1, (v - 1).cast("int")).otherwise(-(F.try_divide(F.lit(1.0), v) - 1).cast("int"))


def score_band(v: Column) -> Column:
    return F.when(v >= 7, "red").when(v >= 4, "orange").otherwise("green")


def region_category(c: Column) -> Column:
    return F.when(c.rlike("תל אביב|Tel Aviv|תל-אביב|מרכז|Center"), 0).otherwise(1)


def location_category(c: Column) -> Column:
    return F.when(c.rlike("גלעין|Core"), 3).when(c.rlike("טבעת|Ring"), 2).otherwise(1)


def terminal_category(c: Column) -> Column:
    return F.when(c.rlike("גדול|משולב"), 3).when(c.rlike("קטן|בינוני"), 2).when(c.contains("לילה"), 1).otherwise(0)
