"""Prompt texts, replies and rules on them as expressions.

A prompt is a fixed template whose slots are filled from a row; a null number
leaves its part out, as an absent field does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import _c

# ---------------------------------------------------------------- fixed values

AXES = ("inflation", "growth", "credit_stress", "policy", "risk_appetite")
ASSETS = {"Asset_A": "world_equity", "Asset_B": "tech_sector", "Asset_C": "gold_commodity", "Asset_D": "short_treasury_cash"}
EXPOSURE = {
    "world_equity": (-0.3, 1.0, -0.8, -0.3, 0.6),
    "tech_sector": (-0.6, 1.0, -0.7, -0.5, 0.8),
    "gold_commodity": (0.8, -0.4, 0.7, 0.1, -0.5),
    "short_treasury_cash": (0.3, -0.6, 0.6, 0.8, -0.6),
}  # in the order of AXES

DIRECTIONAL = """You are a macroeconomic analyst. You are given a point-in-time macro state (z-scored against a rolling 5-year window) and an anonymized list of assets identified only by letter and category. You do not know the calendar date, the year, or the real identity of any asset. Reason only from the numeric state in front of you.

Macro state (z-scores):
{macro_block}

Assets:
{asset_block}

Task: forecast the next-period direction of the FIRST listed asset ({lead_asset}) given this macro state.

Think step by step, then answer with EXACTLY these two final lines and nothing after them:
Direction: <one of -1, 0, 1>   (-1 = down, 0 = flat, 1 = up)
Confidence: <a decimal between 0 and 1>

Example of the required final lines:
Direction: 0
Confidence: 0.50
"""
_EXAMPLE = 'Output a JSON object mapping each axis name to its loading, e.g. {"inflation": 0.4, "growth": -0.2, "credit_stress": 0.6, "policy": -0.1, "risk_appetite": -0.3}.'
_AXES_BLOCK = "\n".join(f"  - {a}" for a in AXES)
LOADINGS = f"""You are a macroeconomic game theorist. Characterize the current macro regime as continuous factor loadings.

You are given the macro state (z-scored against a rolling window) and an anonymized list of assets identified only by letter and category. You do not know what year it is; reason only from the numeric state in front of you.

Macro state (z-scored):
{{macro_block}}

Assets (anonymized):
{{asset_block}}

Characterize the regime as a continuous loading on each of these five macro axes:
{_AXES_BLOCK}

Rules:
  - Each loading is a continuous number in [-1, +1] (use -1 and +1 as the bounds).
  - A loading describes how strongly the regime sits on that axis — it is NOT a trade, a bet, or a prediction.
  - Do NOT output a long/short/neutral position and do NOT output a return for any asset; characterize the regime only.

{_EXAMPLE}"""
IDENTIFYING = """

As-of date: {as_of}

Real asset identities:
{names}

Raw (non-normalized) macro levels:
{levels}"""
PROSE = f"""It is {{as_of}}. You are reading this morning's market commentary before the open, and every desk already knows how this chapter of the macro story goes.

The book holds the usual sleeves — {{names}} — covering {{categories}}.

Today's tape is unambiguous: {{levels}}. Against their rolling history the standardized readings sit at {{macro_block}}.

Write the regime the way the period's history is already told. Characterize it as a continuous loading in [-1, +1] on each of these five macro axes:
{_AXES_BLOCK}

{_EXAMPLE}"""

# ---------------------------------------------------------------- numbers and slots


def filled(template: str, **slots: Column) -> Column:
    """The template with every {slot} replaced; null if one is null."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def rounded_text(x: str | Column, digits: int) -> Column:
    """The shortest text of a number rounded to some digits, ties to even; what rounds to zero from below keeps its sign."""
    r = F.bround(_c(x), digits)
    return F.when((r == 0) & (_c(x) < 0), "-0.0").otherwise(r.cast("string"))


def general_text(x: str | Column) -> Column:
    """Six significant digits, ties to even, without trailing zeros, with an exponent below 1e-4 and from 1e6 on."""
    x = _c(x).cast("double")
    power = F.substring_index(F.format_string("%.5e", x), "e", -1)
    mantissa = F.bround((x / F.pow(F.lit(10.0), power.cast("int"))).cast("decimal(38,18)"), 5)
    plain = (mantissa.cast("double") * F.pow(F.lit(10.0), power.cast("int"))).cast("decimal(38,10)")
    bare = lambda d: F.regexp_replace(d.cast("string"), r"\.?0+$", "")
    return F.when(x == 0, "0").when(power.cast("int").between(-4, 5), bare(plain)).otherwise(F.concat(bare(mantissa), F.lit("e"), power))


def directional(macro: dict[str, Column], assets: list[tuple[str, dict[str, Column]]]) -> Column:
    """The directional prompt: macro fields in the given order to two digits, the numbers of every asset to three."""
    lines = [F.concat(F.lit(f"  {k} = "), rounded_text(v, 2)) for k, v in macro.items()]
    rows = []
    for name, numbers in assets:
        parts = [F.concat(F.lit(f"{label}="), rounded_text(v, 3)) for label, v in numbers.items()]
        rows.append(F.concat_ws(", ", F.lit(f"  - {name} ({ASSETS[name]})"), *parts))
    return filled(DIRECTIONAL, macro_block=F.concat_ws("\n", *lines), asset_block=F.concat_ws("\n", *rows), lead_asset=F.lit(assets[0][0] if assets else "the first asset"))


def loadings_prompt(macro: dict[str, Column]) -> Column:
    """The anonymous loadings prompt: macro fields by name, to two digits with a sign."""
    lines = [F.concat(F.lit(f"  - {k}: "), F.format_string("%+.2f", macro[k])) for k in sorted(macro)]
    return filled(LOADINGS, macro_block=F.concat_ws("\n", *lines), asset_block=F.lit("\n".join(f"  - {a}: {c}" for a, c in ASSETS.items())))


def identified(prompt: Column, as_of: Column, names: dict[str, str], levels: dict[str, Column]) -> Column:
    """A loadings prompt followed by its date, the names behind the letters, and the raw levels."""
    raw = F.concat_ws("\n", *(F.concat(F.lit(f"  - {k}: "), general_text(levels[k])) for k in sorted(levels)))
    return F.concat(prompt, filled(IDENTIFYING, as_of=as_of, names=F.lit("\n".join(f"  - {a}: {n}" for a, n in names.items())), levels=raw))


def prose(as_of: Column, names: list[str], macro: dict[str, Column], levels: dict[str, Column]) -> Column:
    """The narrative prompt with date, names and raw levels."""
    raw = F.concat_ws("; ", *(F.concat(F.lit(f"{k} prints at "), general_text(levels[k])) for k in sorted(levels)))
    z = F.concat_ws("; ", *(F.concat(F.lit(f"{k} at "), F.format_string("%+.2f", macro[k])) for k in sorted(macro)))
    return filled(PROSE, as_of=as_of, names=F.lit(", ".join(names)), categories=F.lit(", ".join(ASSETS.values())), levels=raw, macro_block=z)


# ---------------------------------------------------------------- replies and records


def object_loadings(reply: str | Column) -> Column:
    """Axis to number of the JSON object between the first and the last brace of a reply; what is no number goes.

    Null where there is no object, or more than one between them.
    """
    # within brackets, as what follows a first value would be passed over
    inside = F.try_parse_json(F.concat(F.lit("["), F.regexp_extract(_c(reply), r"(?s)\{.*\}", 0), F.lit("]")))
    v = F.when(F.try_variant_get(inside, "$[1]", "variant").isNull(), F.try_variant_get(inside, "$[0]", "variant"))
    kind = lambda a: F.schema_of_variant(F.try_variant_get(v, f"$.{a}", "variant"))
    number = lambda a: F.when(kind(a).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, f"$.{a}", "double"))
    entries = F.filter(F.array(*(F.struct(F.lit(a).alias("key"), number(a).alias("value")) for a in AXES)), lambda x: x["value"].isNotNull())
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.map_from_entries(entries))


def loadings_reply(loadings: dict[str, Column]) -> Column:
    """The JSON reply that parses back to these loadings; the empty text where one is missing."""
    parts = [F.concat(F.lit(f'"{a}": '), loadings[a].cast("double").cast("string")) for a in AXES]
    known = F.lit(True)
    for a in AXES:
        known = known & loadings[a].isNotNull()
    return F.when(known, F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))).otherwise("")


def look_ahead(kind: str | Column, param: str | Column, value: str | Column) -> Column:
    """Why a change would need data from after its decision, or null: a true ``requires_future`` mark in its JSON value, or a regime view or overlay marked as not walk-forward."""
    mark = F.get_json_object(_c(value), "$.requires_future")
    future = F.coalesce(~mark.isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))
    late = F.coalesce(_c(kind).isin("regime_view", "overlay") & (F.get_json_object(_c(value), "$.walk_forward") == "false"), F.lit(False))
    return F.when(future, F.concat(_c(kind), F.lit(":"), _c(param), F.lit(" requires post-decision (future) data"))).when(
        late, F.concat(_c(kind), F.lit(" fitted on a non-walk-forward window (uses post-decision data)"))
    )
