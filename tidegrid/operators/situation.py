"""All facts of a frame by rules whose thresholds are data: pressure on a site, risk of contact, advantage, confidence.

A frame is one row: both sides' members with places, headings and their own histories, ten of them or so, and what is
known of the round. Each fact adds columns to the row; how far each comparison was from its threshold is kept beside it, as
(rule, metric, value, threshold, margin, decision), and confidence follows from those. Nothing is joined or shuffled after
the row is made, and an unknown is never taken for a zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import at_least, at_most, finite, rounded
from tidegrid.operators import facts
from tidegrid.operators.spatial import distance, placed

Names = Sequence[str]

# The thresholds of the rules in use (places are shares of the map), and which facts a fault of the input bears on.
PRESSURE = {"site_radius": 0.16, "players": 2, "history_seconds": 1.5, "approach": 0.04}
CONTACT = {"high": 0.06, "medium": 0.12, "cue": 0.20, "facing": 0.5, "history_seconds": 1.0, "closing": 0.03}
ADVANTAGE = {
    "radius": 0.14, "alive": 1.0, "alive_most": 2.0, "health": 0.35, "health_most": 1.0, "local": 0.5, "local_most": 1.0, "pressure": 0.5, "planted": 0.75, "defusing": 0.75, "isolation": 0.5,
    "components": 4, "decisive": 1.0, "even": 0.35,
}
CONFIDENCE = {"band": 0.02, "unknowns": 2}
IMPACTS = {
    "missing-frame": ["formation", "pressure", "contact", "isolation", "spatial"], "stale-frame": ["formation", "pressure", "contact", "isolation", "spatial"], "history-truncated": ["pressure", "contact"],
    "history-file-boundary": ["pressure", "contact"], "history-round-boundary": ["pressure", "contact"], "history-gap": ["pressure", "contact"],
    "roster-incomplete": ["formation", "pressure", "contact", "isolation", "spatial"], "position-invalid": ["formation", "pressure", "contact", "isolation", "spatial"],
    "position-outside-radar": ["formation", "pressure", "contact", "isolation", "spatial"], "region-unknown": ["contested", "contact"], "health-state-conflict": ["spatial"],
}
HELD, ARMED, OVER = ("carried", "dropped", "planting"), ("planted", "defusing"), ("defused", "exploded")
EPSILON = 5e-7

MARGIN = "array<struct<rule:string,metric:string,value:double,threshold:double,margin:double,decision:string>>"
MEMBER = "array<struct<id:string,x:double,y:double,region:string,hx:double,hy:double,points:array<struct<tick:long,x:double,y:double>>>>"


def scenes(frames: DataFrame, members: DataFrame, frame: Names) -> DataFrame:
    """frames with t and ct: their living members (id, x, y, region, hx, hy, points by tick), in order of id.

    frames: frame, tick, tick_rate, phase, bomb, site, t_alive, ct_alive, t_health, ct_health, quality (an array of code,
    severity), each null if unknown. members: frame, team, and a member's columns; points: where it was before (tick, x, y).
    Places that are no finite numbers are null, a frame without members has empty sides.
    """
    number = lambda c: finite(F.col(c).cast("double")).alias(c)
    one = F.struct(F.col("id").cast("string").alias("id"), number("x"), number("y"), "region", number("hx"), number("hy"), F.array_sort(F.coalesce("points", F.array().cast("array<struct<tick:long,x:double,y:double>>"))).alias("points"))
    side = lambda name: F.sort_array(F.collect_list(F.when(F.col("team") == name, one))).alias(name.lower())
    made = members.groupBy(*frame).agg(side("T"), side("CT"))
    named = made.select(*(F.col(c).alias(f"__{c}") for c in frame), "t", "ct")
    rows = frames.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in frame], "left").drop(*(f"__{c}" for c in frame))
    return rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(MEMBER)) for c in ("t", "ct")})


def _margin(rule: str | Column, metric: str | Column, value: Column, threshold: float, decision: str) -> Column:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    value = value.cast("double")
    return F.struct(text(rule).alias("rule"), text(metric).alias("metric"), rounded(value).alias("value"), F.lit(float(threshold)).alias("threshold"), rounded(value - F.lit(float(threshold))).alias("margin"), F.lit(decision).alias("decision"))


def _margins(*each: Column) -> Column:
    """Those whose value is known."""
    return F.filter(F.array(*each), lambda m: m["value"].isNotNull()).cast(MARGIN)


def _some(condition: Column, margins: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), margins).otherwise(F.array().cast(MARGIN))


def _d(a: Column, b: Column) -> Column:
    return rounded(distance(a, b))


AT_LEAST, AT_MOST = "greater-or-equal", "less-or-equal"


def _whole(side: str) -> Column:
    """As many members as the frame says, all with places."""
    return F.coalesce((F.size(side) == F.col(f"{side}_alive")) & (F.size(placed(side)) == F.size(side)), F.lit(False))


def with_formations(rows: DataFrame, rules: dict[str, float] = facts.FORMATION) -> DataFrame:
    """t_formation, ct_formation (grouped, split, spread; unknown where members or places are missing), formation_margins."""
    margins = []
    for s in ("t", "ct"):
        rows = facts.with_formation(rows, s, rules)
        known = _whole(s) & (F.col("formation") != "unknown")
        told = (("grouped-coverage", "coverage", "grouped_coverage", AT_LEAST), ("grouped-diameter", "diameter", "grouped_diameter", AT_MOST), ("split-coverage", "split_coverage", "split_coverage", AT_LEAST), ("split-centroid-distance", "split_distance", "split_distance", AT_LEAST))
        rows = rows.withColumn(f"__m{s}", _some(known, _margins(*(_margin(f"formation.{s}", m, F.col(c), rules[r], d) for m, c, r, d in told))))
        rows = rows.withColumn(f"{s}_formation", F.when(known, F.col("formation")).otherwise("unknown")).drop("formation", "coverage", "diameter", "split_coverage", "split_distance")
        margins.append(F.col(f"__m{s}"))
    return rows.withColumn("formation_margins", F.concat(*margins)).drop("__mt", "__mct")


def with_contested(rows: DataFrame) -> DataFrame:
    """contested: the regions, in order, where both sides are; null unless every member's region is known."""
    match = F.coalesce((F.size("t") == F.col("t_alive")) & (F.size("ct") == F.col("ct_alive")), F.lit(False))
    names = lambda s: F.transform(s, lambda p: p["region"])
    known = match & ~F.exists(F.concat(names("t"), names("ct")), lambda r: r.isNull())
    return rows.withColumn("contested", F.when(known, F.array_sort(F.array_intersect(names("t"), names("ct")))))


def with_pressure(rows: DataFrame, sites: dict[str, tuple[float, float]], rules: dict[str, float] = PRESSURE) -> DataFrame:
    """pressure (T-A, CT-B, ...; none; unknown), pressure_side, pressure_site and pressure_margins.

    Before the plant T presses on any site, after it CT on the bomb's. Enough members near a site, or enough that came
    closer since their earliest point that is old enough, make pressure; of several sites the one with the most near,
    then the most coming, the most way covered, the least mean distance and the first name. Unknown: the bomb or its site,
    members or places, a tie, or a history too short to tell where no pressure was found.
    """
    ended = F.coalesce((F.col("phase") == "ended") | F.col("bomb").isin(*OVER), F.lit(False))
    side = F.when(F.col("bomb").isin(*HELD), "T").when(F.col("bomb").isin(*ARMED) & F.col("site").isNotNull(), "CT")
    rows = rows.withColumn("__side", F.when(~ended, side)).withColumn("__own", F.when(F.col("__side") == "T", F.col("t")).when(F.col("__side") == "CT", F.col("ct")))
    ready = F.coalesce(F.when(F.col("__side") == "T", _whole("t")).when(F.col("__side") == "CT", _whole("ct")), F.lit(False))
    rows = rows.withColumn("__ready", ready)
    old = rules["history_seconds"] * F.col("tick_rate") - EPSILON

    def measured(name: str, at: tuple[float, float]) -> Column:
        goal = F.struct(F.lit(float(at[0])).alias("x"), F.lit(float(at[1])).alias("y"))
        own = F.transform("__own", lambda p: F.struct(
            p["id"].alias("id"), _d(p, goal).alias("d"),
            F.get(F.transform(F.filter(p["points"], lambda q: F.col("tick") - q["tick"] >= old), lambda q: rounded(_d(q, goal) - _d(p, goal))), 0).alias("way")))
        coming = lambda o: F.filter(o, lambda m: at_least(m["way"], F.lit(rules["approach"])))
        # lists are made once and then counted
        return F.transform(F.array(own), lambda o: F.struct(
            F.size(F.filter(o, lambda m: at_most(m["d"], F.lit(rules["site_radius"])))).alias("near"), F.size(coming(o)).alias("coming"),
            rounded(F.aggregate(coming(o), F.lit(0.0), lambda a, m: a + m["way"])).alias("way"), F.coalesce(rounded(F.try_divide(F.aggregate(o, F.lit(0.0), lambda a, m: a + m["d"]), F.size(o))), F.lit(float("inf"))).alias("mean"),
            F.lit(name).alias("site"), (~F.exists(o, lambda m: m["way"].isNull())).alias("complete"), o.alias("own")))[0]

    used = F.filter(F.array(*(measured(n, at) for n, at in sorted(sites.items()))), lambda m: (F.col("__side") == "T") | (m["site"] == F.col("site")))
    rows = rows.withColumn("__m", F.when(F.col("__ready"), used))
    fits = lambda m: (m["near"] >= rules["players"]) | (m["coming"] >= rules["players"])
    good = F.filter("__m", fits)
    rank = F.array_sort(F.transform(good, lambda m: F.struct((-m["near"]).alias("a"), (-m["coming"]).alias("b"), (-m["way"]).alias("c"), m["mean"].alias("d"), m["site"].alias("e"))))
    rows = rows.withColumn("__r", rank).withColumn("__b", F.get("__r", F.lit(0)))
    like = F.size(F.filter("__r", lambda r: (r["a"] == F.col("__b")["a"]) & (r["b"] == F.col("__b")["b"]) & (F.abs(r["c"] - F.col("__b")["c"]) <= EPSILON) & (F.abs(r["d"] - F.col("__b")["d"]) <= EPSILON)))
    short = F.exists("__m", lambda m: ~m["complete"] & ~fits(m))
    found = F.col("__ready") & (F.size("__r") > 0) & (like == 1) & ~short
    none = ended | (F.col("__ready") & (F.size("__r") == 0) & ~F.exists("__m", lambda m: ~m["complete"]))
    found, none = F.coalesce(found, F.lit(False)), F.coalesce(none, F.lit(False))
    site = F.when(found, F.col("__b")["e"])
    rule = lambda m: F.concat(F.lit("pressure."), F.lower("__side"), F.lit("."), F.lower(m["site"]))
    told = F.flatten(F.transform("__m", lambda m: F.concat(
        F.transform(F.filter(m["own"], lambda o: o["way"].isNotNull()), lambda o: _margin(rule(m), F.concat(F.lit("approach-"), o["id"]), o["way"], rules["approach"], AT_LEAST)),
        F.array(_margin(rule(m), "near-count", m["near"], rules["players"], AT_LEAST), _margin(rule(m), "approaching-count", m["coming"], rules["players"], AT_LEAST)))))
    return rows.withColumns({
        "pressure": F.when(found, F.concat_ws("-", "__side", site)).when(none, "none").otherwise("unknown"), "pressure_side": F.when(found, F.col("__side")), "pressure_site": site,
        "pressure_margins": _some(F.col("__ready"), told.cast(MARGIN)),
    }).drop("__side", "__own", "__ready", "__m", "__r", "__b")


def with_contact(rows: DataFrame, rules: dict[str, float] = CONTACT) -> DataFrame:
    """contact (low, medium, high, unknown), contact_pair (t, ct, distance, cues and both places) and contact_margins.

    The nearest pair of enemies counts: high when close, or not far with two cues; medium when not far, or within reach with
    one. Cues: one region, one faces the other, the pair came closer since the earliest tick that is old enough and both
    were seen at. A side without members: low. Members or places missing: unknown.
    """
    empty = F.coalesce((F.col("t_alive") == 0) | (F.col("ct_alive") == 0), F.lit(False))
    ready = _whole("t") & _whole("ct") & ~empty
    old = rules["history_seconds"] * F.col("tick_rate") - EPSILON

    def faces(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        far = F.sqrt(dx * dx + dy * dy)
        return F.coalesce((far > EPSILON) & ((a["hx"] * dx + a["hy"] * dy) / F.nullif(far, F.lit(0.0)) + EPSILON >= rules["facing"]), F.lit(False))

    pairs = F.flatten(F.transform("t", lambda a: F.transform("ct", lambda b: F.struct(_d(a, b).alias("distance"), a["id"].alias("t"), b["id"].alias("ct")))))
    rows = rows.withColumn("__n", F.when(ready, F.array_min(pairs)))
    pick = lambda s: F.get(F.filter(s, lambda p: p["id"] == F.col("__n")[s]), 0)
    rows = rows.withColumn("__a", pick("t")).withColumn("__b", pick("ct"))
    a, b, d = F.col("__a"), F.col("__b"), F.col("__n.distance")
    met = F.transform(F.filter(a["points"], lambda p: (F.col("tick") - p["tick"] >= old) & F.exists(b["points"], lambda q: q["tick"] == p["tick"])), lambda p: rounded(
        _d(p, F.get(F.filter(b["points"], lambda q: q["tick"] == p["tick"]), 0)) - d))
    rows = rows.withColumn("__closing", F.get(met, 0))
    closing = F.coalesce(at_least(F.col("__closing"), F.lit(rules["closing"])), F.lit(False))
    same = F.coalesce(a["region"] == b["region"], F.lit(False))
    cues = same.cast("int") + (faces(a, b) | faces(b, a)).cast("int") + closing.cast("int")
    rows = rows.withColumn("__cues", F.when(F.col("__n").isNotNull(), cues))
    near = lambda r: at_most(d, F.lit(rules[r]))
    risk = F.when(near("high") | (near("medium") & (F.col("__cues") >= 2)), "high").when(near("medium") | (near("cue") & (F.col("__cues") >= 1)), "medium").otherwise("low")
    told = _margins(*(_margin("contact-risk", m, d, rules[r], AT_MOST) for m, r in (("high-distance", "high"), ("medium-distance", "medium"), ("cue-distance", "cue"))), _margin("contact-risk", "closing-delta", F.col("__closing"), rules["closing"], AT_LEAST))
    xy = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return rows.withColumns({
        "contact": F.when(empty, "low").when(ready, risk).otherwise("unknown"),
        "contact_pair": F.when(F.col("__n").isNotNull(), F.struct(F.col("__n.t").alias("t"), F.col("__n.ct").alias("ct"), d.alias("distance"), F.col("__cues").alias("cues"), xy(a).alias("from"), xy(b).alias("to"))),
        "contact_margins": _some(F.col("__n").isNotNull(), told),
    }).drop("__n", "__a", "__b", "__closing", "__cues")


def with_isolation(rows: DataFrame, rules: dict[str, float] = facts.ISOLATION) -> DataFrame:
    """isolated (T, CT, both, none, unknown), t_isolated and ct_isolated (ids in order, null if unknown), isolation_margins."""
    ready = _whole("t") & _whole("ct")
    margins = []
    for own, other in (("t", "ct"), ("ct", "t")):
        near = lambda p, s: F.array_min(F.transform(F.filter(s, lambda q: q["id"] != p["id"]), lambda q: _d(p, q)))
        each = F.transform(own, lambda p: F.struct(p["id"].alias("id"), near(p, own).alias("ally"), near(p, other).alias("enemy")))  # noqa: B023
        rows = rows.withColumn(f"__{own}", F.when(ready & (F.size(own) > 1) & (F.size(other) > 0), each))
        lonely = F.filter(f"__{own}", lambda m: at_least(m["ally"], F.lit(rules["ally_distance"])) & at_least(m["ally"] - m["enemy"], F.lit(rules["enemy_closer"])))
        ids = lambda c: F.transform(c, lambda m: m["id"])
        found = F.when((F.size(own) == 0) | (F.size(other) == 0), F.array().cast("array<string>")).when(F.size(own) == 1, ids(F.col(own))).otherwise(F.array_sort(ids(lonely)))
        rows = rows.withColumn(f"{own}_isolated", F.when(ready, found))
        rule = lambda m: F.concat(F.lit(f"isolation.{own}."), m["id"])  # noqa: B023, E731
        told = F.flatten(F.transform(f"__{own}", lambda m: F.array(  # noqa: B023
            _margin(rule(m), "ally-distance", m["ally"], rules["ally_distance"], AT_LEAST), _margin(rule(m), "enemy-closer-margin", m["ally"] - m["enemy"], rules["enemy_closer"], AT_LEAST))))
        margins.append(_some(F.col(f"__{own}").isNotNull(), told.cast(MARGIN)))
    t, ct = F.size("t_isolated") > 0, F.size("ct_isolated") > 0
    kind = F.when(F.col("t_isolated").isNull() | F.col("ct_isolated").isNull(), "unknown").when(t & ct, "both").when(t, "T").when(ct, "CT").otherwise("none")
    return rows.withColumn("isolated", kind).withColumn("isolation_margins", F.concat(*margins)).drop("__t", "__ct")


def _clamped(x: Column, most: float) -> Column:
    """Null stays null, which greatest and least would skip."""
    return F.when(x.isNotNull(), rounded(F.greatest(F.least(x, F.lit(most)), F.lit(-most))))


def _faulty(severity: str, scope: str | None = None) -> Column:
    """Whether a fault of the severity bears on the scope (any, if none is given)."""
    codes = [c for c, scopes in IMPACTS.items() if scopes and (scope is None or scope in scopes)]
    return F.coalesce(F.exists("quality", lambda q: (q["severity"] == severity) & q["code"].isin(codes)), F.lit(False))


def with_advantage(rows: DataFrame, rules: dict[str, float] = ADVANTAGE) -> DataFrame:
    """advantage (T, CT, even, uncertain), score, components (a map of what is known) and advantage_margins.

    Rows of with_pressure, with_contact and with_isolation. Components: alive, health, local (members around the middle of the
    nearest pair), pressure, bomb, isolation, each clamped. One that is unknown is left out, not zero; with too few of them,
    or an error that bears on places, the result is uncertain, as it is between even and decisive.
    """
    pair = F.col("contact_pair")
    middle = F.struct(((pair["from"]["x"] + pair["to"]["x"]) / 2).alias("x"), ((pair["from"]["y"] + pair["to"]["y"]) / 2).alias("y"))
    around = lambda s: F.size(F.filter(s, lambda p: at_most(_d(p, middle), F.lit(rules["radius"]))))
    sign = lambda c, amount: F.when(c == "T", F.lit(amount)).when(c == "CT", F.lit(-amount)).otherwise(F.lit(0.0))
    bomb = F.when(F.col("bomb") == "planted", F.lit(rules["planted"])).when(F.col("bomb") == "defusing", F.lit(-rules["defusing"])).otherwise(F.lit(0.0))
    parts = {
        "alive": _clamped((F.col("t_alive") - F.col("ct_alive")) * rules["alive"], rules["alive_most"]), "health": _clamped((F.col("t_health") - F.col("ct_health")) / 100.0 * rules["health"], rules["health_most"]),
        "local": F.when(pair.isNotNull(), _clamped((around("t") - around("ct")) * rules["local"], rules["local_most"])), "pressure": F.when(F.col("pressure") != "unknown", sign(F.coalesce("pressure_side", F.lit("")), rules["pressure"])),
        "bomb": F.when(F.coalesce(F.col("bomb"), F.lit("unknown")) != "unknown", bomb), "isolation": F.when(F.col("isolated") != "unknown", sign(F.col("isolated"), -rules["isolation"])),
    }
    rows = rows.withColumn("components", F.map_filter(F.create_map(*(x for k, v in sorted(parts.items()) for x in (F.lit(k), v.cast("double")))), lambda k, v: v.isNotNull()))
    rows = rows.withColumn("score", F.when(F.size("components") > 0, rounded(F.aggregate(F.map_values("components"), F.lit(0.0), lambda a, v: a + v))))
    s = F.col("score")
    told = s.isNotNull() & (F.size("components") >= rules["components"]) & ~_faulty("error", "spatial")
    kind = F.when(~told, "uncertain").when(at_least(s, F.lit(rules["decisive"])), "T").when(at_most(s, F.lit(-rules["decisive"])), "CT").when(at_most(F.abs(s), F.lit(rules["even"])), "even").otherwise("uncertain")
    margins = F.concat(
        _some(pair.isNotNull(), _margins(F.struct(F.lit("spatial-advantage").alias("rule"), F.lit("local-radius").alias("metric"), F.lit(rules["radius"]).alias("value"), F.lit(rules["radius"]).alias("threshold"), F.lit(0.0).alias("margin"), F.lit("configured-radius").alias("decision")))),
        _some(s.isNotNull(), _margins(_margin("spatial-advantage", "decisive-score", F.abs(s), rules["decisive"], AT_LEAST), _margin("spatial-advantage", "even-score", F.abs(s), rules["even"], AT_MOST))),
    )
    return rows.withColumn("advantage", F.coalesce(kind, F.lit("uncertain"))).withColumn("advantage_margins", margins)


MARGINS = ("formation_margins", "pressure_margins", "contact_margins", "isolation_margins", "advantage_margins")


def with_confidence(rows: DataFrame, rules: dict[str, float] = CONFIDENCE) -> DataFrame:
    """confidence (low, medium, high), unknowns (how many of the seven facts are), and margins, all of them in one array.

    Rows with all facts. Low: an error that bears on any fact, or too many unknowns. Medium: a warning that does, one
    unknown, or a comparison within the band of its threshold. A configured radius is no comparison.
    """
    unknown = [F.col(c) == "unknown" for c in ("t_formation", "ct_formation", "pressure", "contact", "isolated")] + [F.col("contested").isNull(), F.col("advantage") == "uncertain"]
    count = sum(c.cast("int") for c in unknown)
    rows = rows.withColumn("margins", F.concat(*MARGINS)).withColumn("unknowns", count)
    close = F.exists("margins", lambda m: (m["decision"] != "configured-radius") & (F.abs(m["margin"]) <= rules["band"] + EPSILON))
    kind = F.when(_faulty("error") | (F.col("unknowns") >= rules["unknowns"]), "low").when(_faulty("warning") | (F.col("unknowns") == 1) | close, "medium").otherwise("high")
    return rows.withColumn("confidence", kind).drop(*MARGINS)


def analysed(rows: DataFrame, sites: dict[str, tuple[float, float]]) -> DataFrame:
    """scenes() with every fact."""
    out = with_isolation(with_contact(with_pressure(with_contested(with_formations(rows)), sites)))
    return with_confidence(with_advantage(out))


def margin_rows(rows: DataFrame, frame: Names) -> DataFrame:
    """(frame, rule, metric, value, threshold, margin, decision), a row for each comparison."""
    # an inner explode would push a filter on the array, and with it all that makes it, through every step below
    return rows.select(*frame, F.explode_outer("margins").alias("m")).filter("m IS NOT NULL").select(*frame, "m.*")


def merged_quality(faults: DataFrame, keys: Names, path: str = "path") -> DataFrame:
    """(keys, code, severity, paths): one row for each code and severity, with its distinct field paths in order."""
    return faults.groupBy(*keys, "code", "severity").agg(F.array_sort(F.collect_set(path)).alias("paths"))
