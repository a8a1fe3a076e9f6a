"""The same results in plain SQL, for checking the queries in another engine.

Written from the definition of each operator, not from its Spark form: medians
are medians, as-of joins are ASOF joins, headers are never parsed.
"""

from __future__ import annotations

from collections.abc import Sequence

from .fixture import oracle_obs
from .specs import (
    COMMON_SENTINELS, ICARTT_SENTINELS, IPHEX_SENTINELS, ISDAC_SENTINELS, MACPEX_SENTINELS,
)

OBS = f"with obs as ({oracle_obs()})"


def dbl(x: float) -> str:
    return f"cast({x!r} as double)"


def r6(expr: str) -> str:
    """Six decimals; adding zero turns -0.0 into 0.0."""
    return f"(round({expr}, 6) + cast(0 as double))"


def mask(col: str, flags: Sequence[float], scale: float | None = None) -> str:
    values = ", ".join(dbl(float(f) if scale is None else f * scale) for f in flags)
    return f"(case when {col} not in ({values}) then {col} end)"


def keep(col: str, low: float, high: float) -> str:
    return f"(case when {col} between {dbl(low)} and {dbl(high)} then {col} end)"


def es_mk(t: str) -> str:
    k = f"({t} + {dbl(273.15)})"
    return f"exp({dbl(9.550426)} - {dbl(5723.265)}/{k} + {dbl(3.53068)}*ln({k}) - {dbl(0.007283)}*{k})"


def es_tetens(t: str) -> str:
    return f"({dbl(6.112)} * exp({dbl(22.46)}*{t}/({dbl(272.62)}+{t})))"


def si_mk(f: str, t: str) -> str:
    return f"({es_mk(f)}/{es_mk(t)} - 1)"


def si_tetens(f: str, t: str) -> str:
    return f"({es_tetens(f)}/{es_tetens(t)} - 1)"


def si_ppmv(q: str, t: str, p: str, bounded: bool = True) -> str:
    limits = f" and {t} between 150 and 350" if bounded else ""
    saturated = f"({dbl(6.112)}*exp({dbl(22.46)}*({t}-{dbl(273.15)})/({t}-{dbl(0.55)})))"
    return f"(case when {q} > 0 and {p} > 0{limits} then {q}/1e6*{p}/{saturated} - 1 end)"


def common(col: str) -> str:
    return mask(col, COMMON_SENTINELS)


def icartt(col: str) -> str:
    return mask(col, ICARTT_SENTINELS)


T01, P01 = f"({icartt('raw_t')}*{dbl(0.01)})", f"({icartt('raw_p')}*{dbl(0.01)})"
P1 = f"({icartt('raw_p')}*{dbl(0.1)})"
SI_PPMV = si_ppmv(icartt("h2o_ppmv"), T01, P01)
SI_PPMV_FREE = si_ppmv(icartt("h2o_ppmv"), T01, P01, bounded=False)


def over_file(col: str, by: str = "source_file") -> str:
    return f"(median({col}) over (partition by {by}))"


def kelvin(col: str) -> str:
    return f"(case when {over_file(col)} > 150 then {col} - {dbl(273.15)} else {col} end)"


def pascal(col: str) -> str:
    return f"(case when {over_file(col)} > 2000 and {over_file(col)} < 120000 then {col}/100 else {col} end)"


def feet(col: str) -> str:
    return f"(case when {over_file(col)} >= 12000 and {over_file(col)} <= 70000 then {col}*{dbl(0.3048)} else {col} end)"


_IPHEX = {n: mask(n, IPHEX_SENTINELS) for n in ("tair", "frost", "pres", "lat", "lon", "alt")}
REFINED = f"""{OBS},
masked as (select row_no, ts, campaign, source_file, {", ".join(f"{e} as {n}" for n, e in _IPHEX.items())} from obs),
guarded as (select row_no, ts, campaign, source_file, {kelvin("tair")} as tair, {kelvin("frost")} as frost,
  {pascal("pres")} as pres, lat, lon, {feet("alt")} as alt from masked),
ranged as (select row_no, ts, campaign, source_file, {keep("tair", -95, 60)} as tair, {keep("frost", -120, 40)} as frost,
  {keep("pres", 50, 1100)} as pres, {keep("lat", -90, 90)} as lat, {keep("lon", -180, 180)} as lon,
  {keep("alt", -500, 25000)} as alt from guarded),
crossed as (select * replace (case when frost > tair + 20 then null else frost end as frost) from ranged),
withsi as (select *, {si_tetens("frost", "tair")} as si0 from crossed),
std as (select ts as "Timestamp", tair as "Tair_C", {keep("si0", -1, 5)} as "Si", lat as "Lat", lon as "Lon", alt as "Alt_m",
  campaign as "Campaign", source_file from withsi)"""
DOUBLES = ("Tair_C", "Si", "Lat", "Lon", "Alt_m")
ROUNDED = ", ".join(f'{r6(chr(34) + n + chr(34))} as "{n}"' for n in DOUBLES)


def fills(name: str, bounds: tuple[float, float] | None = None) -> str:
    value = mask(name, (-9999, -99999, -999999, -9999999, -99999999, -999999999))
    return f"(case when {value} between {bounds[0]} and {bounds[1]} then {value} end)" if bounds else value


CLEAN = f"""{REFINED}, cleaned as (select "Timestamp", {fills('"Tair_C"')} as "Tair_C", {fills('"Si"')} as "Si",
  {fills('"Lat"', (-90, 90))} as "Lat", {fills('"Lon"', (-180, 180))} as "Lon", {fills('"Alt_m"')} as "Alt_m",
  "Campaign", source_file from std)"""


def nearest(left: str, right: str, out: str, tolerance: str, by: str = "", pick: str = "v", last: str = "v", first: str = "v") -> str:
    """Two ASOF joins and the nearer of both.  ``l``/``r`` have ``ts`` (and keys)."""
    key = "".join(f" and l.{k} = r.{k}" for k in by.split(",") if k)
    columns = ", ".join(f"l.{c}" for c in out.split(","))
    keep_columns = ", ".join(f"b.{c}" for c in out.split(","))
    return f"""b as (select {columns}, l.ts as lt, r.ts as bt, r.{last} as bv from {left} l asof left join {right} r on l.ts >= r.ts{key}),
f as (select {columns}, r.ts as ft, r.{first} as fv from {left} l asof left join {right} r on l.ts <= r.ts{key}),
n as (select {keep_columns}, case
   when bt is not null and lt - bt <= {tolerance} and (ft is null or lt - bt <= ft - lt) then bv
   when ft is not null and ft - lt <= {tolerance} then fv end as {pick} from b join f using ({out}))"""


def instrument(name: str, alias: str) -> str:
    return f"{alias} as (select row_no, ts, user_id, source_file, lat from obs where campaign = '{name}')"


LINES_OK = "lineitem join supplier on l_suppkey = s_suppkey"
AT = "(l_orderkey*8 + l_linenumber)"


def supplier_file(suffix: str) -> str:
    return f"concat('S', cast(l_suppkey as varchar), '{suffix}')"


def clock_after(day: str, seconds: str) -> str:
    return f"(cast(date '{day}' as timestamp) + to_microseconds(cast(floor({seconds}*1000000 + 0.5) as bigint)))"


ORACLE: dict[str, str] = {
    # ---------------------------------------------------------- scalar functions
    "si_ppmv": f"{OBS} select row_no, {r6(SI_PPMV)} as si from obs",
    "si_frost_mk": f"{OBS} select row_no, {r6(si_mk(common('frost'), common('tair')))} as si from obs",
    "si_frost_tetens": f"{OBS} select row_no, {r6(si_tetens(common('frost'), common('tair')))} as si from obs",
    "si_rh": f"{OBS} select row_no, {r6(icartt('rh_ice') + '/100 - 1')} as si from obs",
    "affine_decode": f"""{OBS} select row_no, {r6('raw_t*' + dbl(0.01))} as t_k, {r6('raw_p*' + dbl(0.1))} as p_hpa,
        {r6('raw_t/1000 - 100')} as decoded, {r6('alt*' + dbl(1e-5))} as lat_deg, {r6('tair - ' + dbl(273.15))} as t_c,
        {r6('alt*' + dbl(0.3048))} as alt_m from obs""",
    "yymmdd_decode": """select o_orderkey, case when o_orderpriority <> '1-URGENT' then strftime(
        make_date(2000 + cast(year(o_orderdate) as integer) % 100, cast(month(o_orderdate) as integer), cast(day(o_orderdate) as integer)), '%Y-%m-%d') end as flight_date from orders""",
    "seconds_to_ts": f"""{OBS} select row_no, case when qc <> 3 then cast(cast(ts as date) as timestamp)
        + to_microseconds(row_no*13125000) end as stamp from obs""",
    "hms_to_ts": f"""{OBS} select row_no, cast(cast(ts as date) as timestamp) + to_seconds(
        (case when qc <> 1 then row_no%24 else 0 end)*3600 + (row_no%60)*60 + (case when qc <> 2 then row_no%59 else 0 end)) as stamp from obs""",
    "numeric_coerce": """select event_id, case event_type when 'click' then value when 'view' then cast(concat(cast(event_id as varchar), 'e-1') as double) end as number from events""",
    # -------------------------------------------------------- masks and filters
    "sentinel_mask": f"""{OBS} select row_no, {icartt('raw_t')} as raw_t, {icartt('raw_p')} as raw_p, {icartt('h2o_ppmv')} as h2o,
        {r6(common('tair'))} as tair, {r6(common('frost'))} as frost, {mask('rh_ice', ISDAC_SENTINELS)} as rh from obs""",
    "scaled_sentinel_mask": f"""{OBS}, s as (select row_no, raw_p*{dbl(0.1)} as p, pres from obs)
        select row_no, {r6(mask('p', MACPEX_SENTINELS, 0.1))} as p_hpa, {mask('pres', MACPEX_SENTINELS, 100)} as pres from s""",
    "range_mask": f"""{OBS} select row_no, {r6(keep('tair', -95, 60))} as tair, {keep('pres', 50, 1100)} as pres, {keep('lat', -90, 90)} as lat,
        {keep('lon', -180, 180)} as lon, {keep('alt', -500, 25000)} as alt,
        case when raw_p > 0 and raw_p <= 1100 then raw_p end as p_open from obs""",
    "cross_mask": f"""{OBS}, m as (select row_no, {common('frost')} as frost, {common('tair')} as tair from obs)
        select row_no, {r6('case when tair is not null and frost > tair + 20 then null else frost end')} as frost from m""",
    "positive_mask": f"{OBS} select row_no, case when h2o_ppmv > 0 then h2o_ppmv end as h2o, case when lat > 0 then lat end as lat from obs",
    "clip_si": f"{OBS}, s as (select row_no, {SI_PPMV_FREE} as si from obs) select row_no, {r6('case when si > 1 then 1 when si < -1 then -1 else si end')} as si from s",
    "magnitude_mask": f"{OBS}, s as (select row_no, {si_mk(common('frost'), common('tair'))} as si from obs) select row_no, {r6('case when si between -10 and 10 then si end')} as si from s",
    "row_filter_rh": f"{OBS} select row_no, {icartt('rh_ice')} as rh from obs where {icartt('rh_ice')} <= 200",
    "row_qc_filter": f"{OBS} select row_no from obs where qc < 2 and campaign <> 'error'",
    # ------------------------------------------------------------------- guards
    "guard_kelvin": f"""{OBS}, m as (select row_no, source_file, {common('tair')} as tair, {common('frost')} as frost from obs)
        select row_no, {r6(kelvin('tair'))} as tair, {r6(kelvin('frost'))} as frost from m""",
    "guard_pascal": f"{OBS}, m as (select row_no, source_file, {common('pres')} as pres from obs) select row_no, {r6(pascal('pres'))} as pres from m",
    "guard_feet": f"{OBS} select row_no, {r6(feet('alt'))} as alt_m from obs",
    "guard_celsius_to_k": f"""{OBS}, m as (select row_no, campaign, {common('tair')} as t from obs)
        select row_no, {r6(f"case when {over_file('t', 'campaign')} > 200 then t else t + {dbl(273.15)} end")} as t_k from m""",
    # -------------------------------------------------------------------- joins
    "asof_nearest_1": f"""{OBS}, {instrument('click', 'l')}, r as (select ts, {{'no': row_no, 'lat': lat}} as v from obs where campaign = 'view'),
        {nearest('l', 'r', 'row_no', 'interval 10 second')}
        select l.row_no, l.ts, n.v.no as view_row_no, n.v.lat as view_lat from l join n on l.row_no = n.row_no""",
    "asof_nearest_wide": f"""{OBS}, {instrument('click', 'l')}, r as (select ts, row_no as v from obs where campaign = 'purchase'),
        {nearest('l', 'r', 'row_no', 'interval 600 second')} select row_no, v as buy_row_no from n""",
    "asof_nearest_by_key": f"""{OBS}, {instrument('click', 'l')}, r as (select ts, user_id, row_no as v from obs where campaign = 'view'),
        {nearest('l', 'r', 'row_no', 'interval 86400 second', by='user_id')} select row_no, v as view_row_no from n""",
    "asof_nearest_dups": f"""with l as (select o_orderkey, o_custkey as k, o_orderdate as ts from orders where o_orderpriority <> '5-LOW'),
        r as (select l_partkey as k, l_shipdate as ts,
            max({{'a': l_orderkey, 'b': l_linenumber, 'c': l_quantity}}) as hi, min({{'a': l_orderkey, 'b': l_linenumber, 'c': l_quantity}}) as lo
            from lineitem group by 1, 2),
        {nearest('l', 'r', 'o_orderkey', 'interval 20 day', by='k', last='hi', first='lo')}
        select o.o_orderkey, n.v.a as l_orderkey, n.v.b as l_linenumber, n.v.c as l_quantity from orders o left join n on o.o_orderkey = n.o_orderkey""",
    "asof_fold_3way": f"""{OBS}, {instrument('click', 'l')},
        p as (select ts, {{'no': row_no, 'f': source_file}} as v from obs where campaign = 'purchase'),
        w as (select ts, {{'no': row_no, 'f': source_file}} as v from obs where campaign = 'view'),
        np as (with {nearest('l', 'p', 'row_no', 'interval 60 second')} select * from n),
        nw as (with {nearest('l', 'w', 'row_no', 'interval 60 second')} select * from n)
        select l.row_no, np.v.no as purchase_row_no, nw.v.no as view_row_no,
          concat(l.source_file, '+', coalesce(np.v.f, 'nan'), '+', coalesce(nw.v.f, 'nan')) as sources
        from l join np on l.row_no = np.row_no join nw on l.row_no = nw.row_no""",
    "equi_left_nullsafe": """with l as (select l_orderkey as pair, l_linenumber, case when l_returnflag <> 'A' then l_shipdate end as ts from lineitem),
        r as (select l_orderkey as pair, case when l_linestatus <> 'F' then l_shipdate end as ts, l_quantity as tair from lineitem)
        select l.pair, l.l_linenumber, r.tair from l left join r on l.pair = r.pair and l.ts is not distinct from r.ts""",
    "positional_align": f"""{OBS} select source_file, row_no as idx, alt as "ATX",
        case when qc <= 1 and campaign <> 'purchase' then rh_ice end as "RHUM" from obs where qc <> 3""",
    "gridded_select": f"""{OBS}, x as (select *,
          count(*) filter (where qc <> 3) over (partition by source_file) as n_axis,
          count(*) filter (where qc <= 1 and campaign <> 'purchase') over (partition by source_file) as n_rh,
          count(*) filter (where campaign <> 'view' and qc <> 2) over (partition by source_file) as n_lat,
          count(*) filter (where qc = 0) over (partition by source_file) as n_lon from obs)
        select source_file, row_no as idx, alt as atx, case when qc <= 1 then rh_ice end as rh,
          case when n_lat > 0 then case when qc <> 2 then lat end else lon end as lat,
          case when n_lon >= n_axis and qc = 0 then pres end as lon from x where qc <> 3 and n_rh > 0""",
    # ------------------------------------------------- projection and pipeline
    "standard_projection": f'{REFINED} select "Timestamp", {ROUNDED}, "Campaign", source_file from std',
    "generic_projection": f"""{OBS} select ts as "Timestamp", {r6(common('tair'))} as "Tair_C", {r6(icartt('rh_ice') + '/100 - 1')} as "Si",
        cast(null as double) as "Lat", cast(null as double) as "Lon", cast(null as double) as "Alt_m", 'GENERIC' as "Campaign", source_file from obs""",
    "source_concat": f"""{OBS}, s as (select row_no, source_file as a, coalesce(case when qc <> 1 then campaign end, 'nan') as b, cast(row_no as varchar) as d from obs)
        select row_no, concat(a, '|', b, '|', d) as bar_joined, concat(a, '+', b, '+', d) as plus_joined from s""",
    "union_by_name_missing": f"""{OBS} select row_no, {r6('tair')} as "Tair_C", case when campaign <> 'view' then source_file end as source_file,
        case when campaign = 'view' then pres end as "Pressure_hPa" from obs""",
    "si_alternates": f"""{OBS}, b as (select row_no, {icartt('h2o_ppmv')} as dlh, lat as jlh,
          case when {T01} between 150 and 350 then {T01} end as t, case when {P1} between 10 and 1100 then {P1} end as p from obs),
        s as (select row_no, {si_ppmv('dlh', 't', 'p')} as d, {si_ppmv('(dlh*2)', 't', 'p')} as h, {si_ppmv('jlh', 't', 'p')} as j from b)
        select row_no, {r6(keep('d', -1, 1))} as "Si_DLH", {r6(keep('h', -1, 1))} as "Si_HWV", {r6(keep('j', -1, 1))} as "Si_JLH" from s""",
    # --------------------------------------------------------------- aggregates
    "campaign_summary": f"""{REFINED} select "Campaign", count("Timestamp") as n_records, min("Timestamp") as earliest, max("Timestamp") as latest,
        {r6('avg("Tair_C")')} as tair_mean, {r6('stddev_samp("Tair_C")')} as tair_std, {r6('avg("Si")')} as si_mean, {r6('stddev_samp("Si")')} as si_std
        from std group by 1""",
    "sink_roundtrip": f"""{REFINED} select "Campaign", count(*) as n_rows, min("Timestamp") as earliest, max("Timestamp") as latest,
        cast(0 as bigint) as n_out_of_order, count("Si") as n_si from std group by 1""",
    "missing_report": f"""{REFINED}, k as (""" + " union all ".join(
        f"""select '{n}' as column_name, count(*) - count("{n}") as n_missing, count(*) as total from std"""
        for n in ("Timestamp", *DOUBLES, "Campaign", "source_file")
    ) + ") select column_name, n_missing, round(n_missing / total * 100, 2) as pct_missing from k where n_missing > 0",
    "valid_count": f"""{REFINED} select "Campaign", count(*) as n_rows, count(*) filter (where "Timestamp" is not null and "Tair_C" is not null and "Si" is not null) as n_valid from std group by 1""",
    "distinct_campaigns": f"""{REFINED} select "Campaign", count(*) as n_rows, (select count(*) from std) as total_rows from std group by 1""",
    "distribution_stats": f"""{REFINED} select "Campaign", {r6('min("Si")')} as min, {r6('quantile_cont("Si", 0.25)')} as q1, {r6('median("Si")')} as median,
        {r6('quantile_cont("Si", 0.75)')} as q3, {r6('max("Si")')} as max, {r6('avg("Si")')} as mean, {r6('stddev_pop("Si")')} as std from std where "Si" is not null group by 1""",
    "distribution_drift": f"""{REFINED}, m as (select "Campaign", abs(quantile_cont("Si", 0.25) + 0.3599) as a, abs(median("Si") + 0.1299) as b,
          abs(quantile_cont("Si", 0.75) - 0.0168) as d, abs(avg("Si") + 0.1615) as e, abs(stddev_pop("Si") - 0.3688) as f from std where "Si" is not null group by 1)
        select "Campaign", {r6('a')} as d_q1, {r6('b')} as d_median, {r6('d')} as d_q3, {r6('e')} as d_mean, {r6('f')} as d_std,
          a <= 0.20 and b <= 0.20 and d <= 0.20 and e <= 0.20 and f <= 0.20 as aligned from m""",
    "group_median": f"""{OBS}, m as (select source_file, {common('tair')} as t from obs) select source_file, {r6('median(t)')} as median from m where t is not null group by 1""",
    "qa_campaign_stats": f"""{CLEAN} select "Campaign", count(*) as n_records, {r6('avg("Tair_C")')} as "temp_mean_C", {r6('stddev_samp("Tair_C")')} as "temp_std_C",
        {r6('avg("Lat")')} as lat_mean, {r6('avg("Lon")')} as lon_mean, {r6('avg("Alt_m")')} as alt_mean_m, {r6('avg("Si")')} as si_mean, {r6('stddev_samp("Si")')} as si_std
        from cleaned group by 1 order by 1""",
    "mask_counters": f"""{OBS}, m as (select *, {common('tair')} as t, {common('pres')} as p from obs), k as (""" + " union all ".join(
        f"select campaign, '{rule}' as rule, count(*) filter (where {raw} is not null and ({bad})) as n_masked from m group by 1"
        for rule, raw, bad in (
            ("temperature_flag", "tair", "t is null"),
            ("temperature_range", "t", "t < -95 or t > 60"),
            ("pressure_range", "p", "p < 50 or p > 1100"),
            ("vapour_positive", "h2o_ppmv", "h2o_ppmv <= 0"),
            ("latitude_range", "lat", "lat < -90 or lat > 90"),
        )
    ) + ") select campaign, rule, n_masked from k",
    "duplicate_rows": f"""{OBS} select campaign, source_file, cast(floor(rh_ice/10) as bigint) as rh_bin, count(*) as n_copies from obs group by 1, 2, 3 having count(*) > 1""",
    "qa_fill_replace": f"""{OBS} select row_no, {fills('lat', (-90, 90))} as "Lat", {fills('lon', (-180, 180))} as "Lon", {fills('rh_ice')} as "Alt_m", {fills('raw_t')} as "Tair_C" from obs""",
    "qa_report": f"""{CLEAN}, g as (select "Campaign" as campaign, cast(count(*) as double) as n, cast(count(*) - count("Timestamp") as double) as nt,
          cast(0 as double) as nc, min("Tair_C") as t0, max("Tair_C") as t1, min("Lat") as a0, max("Lat") as a1, min("Lon") as o0, max("Lon") as o1, min("Alt_m") as h0
          from cleaned group by 1),
        d as (select count(*) - (select count(*) from (select distinct * from cleaned)) as n from cleaned),
        e as (select unnest(['click', 'view', 'purchase', 'error', 'signup', 'landing']) as campaign),
        k as (""" + " union all ".join(
        f"select '{check}' as \"check\", campaign, {value} as value, coalesce({test}, true) as passed from g"
        for check, value, test in (
            ("rows", "n", "n > 0"), ("null_timestamp", "nt", "nt = 0"), ("null_campaign", "nc", "nc = 0"),
            ("tair_min", "t0", "t0 > -150"), ("tair_max", "t1", "t1 < 200"), ("lat_min", "a0", "a0 >= -90"), ("lat_max", "a1", "a1 <= 90"),
            ("lon_min", "o0", "o0 >= -180"), ("lon_max", "o1", "o1 <= 180"), ("alt_min", "h0", "h0 >= -1000"),
        )
    ) + f""" union all select 'duplicates', null, cast(n as double), n = 0 from d
        union all select 'present', e.campaign, coalesce(g.n, 0), coalesce(g.n, 0) > 0 from e left join g on e.campaign = g.campaign)
        select "check", campaign, {r6('value')} as value, passed from k""",
}

# ------------------------------------------------------------------ all campaigns
ORACLE["harmonise_all"] = f"""{OBS},
m as (select * replace ({common('tair')} as tair, {common('frost')} as frost, {common('pres')} as pres) from obs),
g as (select *, {kelvin('tair')} as gt, {kelvin('frost')} as gf, {feet('alt')} as galt from m),
b as (select *, {keep('gt', -95, 60)} as bt, {keep('gf', -120, 40)} as bf from g),
s as (select *, {icartt('rh_ice')}/100 - 1 as srh, {T01} as tk, {P01} as ph, {SI_PPMV_FREE} as sq,
  case when campaign = 'click' then {si_mk('frost', 'tair')} end as smk,
  case when campaign = 'error' then {si_tetens('bf', 'bt')} end as ste from b),
k as (select ts as "Timestamp",
  case campaign when 'click' then tair when 'view' then tair when 'purchase' then tk - {dbl(273.15)} else bt end as "Tair_C",
  case campaign when 'click' then smk when 'error' then {keep('ste', -1, 5)} when 'signup' then {keep('srh', -1, 5)} when 'view' then srh
    else case when sq > 1 then 1 when sq < -1 then -1 else sq end end as "Si",
  case when campaign in ('error', 'signup') then {keep('lat', -90, 90)} else lat end as "Lat",
  case when campaign in ('error', 'signup') then {keep('lon', -180, 180)} else lon end as "Lon",
  case when campaign in ('error', 'signup') then {keep('alt', -500, 25000)} when campaign = 'view' then galt else alt end as "Alt_m",
  campaign as "Campaign", source_file,
  case when campaign = 'purchase' then tk end as "Tair_K", case when campaign = 'purchase' then ph end as "Pressure_hPa" from s)
select "Timestamp", {ROUNDED}, "Campaign", source_file, {r6('"Tair_K"')} as "Tair_K", {r6('"Pressure_hPa"')} as "Pressure_hPa" from k"""


# ----------------------------------------------------------------------- headers

def clean(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[^A-Za-z0-9_]+', '_', 'g'), '_')"


ORACLE |= {
    "header_clean_name": f"select p_partkey, {clean(chr(39) + '  ' + chr(39) + ' || p_name || ' + chr(39) + ' (' + chr(39) + ' || p_type || ' + chr(39) + ')/' + chr(39) + ' || p_brand')} as name from part",
    "header_units_pairs": f"""select p_partkey, concat('UT_s|T_K|RH|', {clean('p_brand')}, '_', cast(p_size as varchar), '|Z') as names from part""",
    "header_dedup": """select c_custkey, concat_ws('|', 'HH', 'MM', 'SS', c_mktsegment, 'HH_1', 'unnamed', c_mktsegment || '_1', 'HH_2', 'unnamed_1') as names from customer""",
    "header_dates": """with t as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders)
        select o_orderkey, d as blank_line, d as comma_line, d as text_line, d as from_name, d as from_start, d as from_metadata from t""",
    "header_metadata": """select o_orderkey, cast(4 as bigint) as n_keys, o_orderpriority as platform, o_orderstatus as order_status,
        case when o_orderpriority = '1-URGENT' then 'Suspect data, x' else 'fine, x' end as qc_level,
        o_orderpriority in ('1-URGENT', '5-LOW') as file_is_bad from orders""",
    "header_choose_column": """select p_partkey, case when p_size > 25 then 'UTC_sec' else 'elapsed time' end as time_name,
        case p_size % 3 when 0 then 'air-temp' when 1 then 'Temp' else 'My_Temperature_x' end as temp_name,
        case when p_size % 2 = 0 then 'GPS_Lat' else 'PLATE' end as lat_name from part""",
}

ORACLE["header_instrument"] = f"""{OBS} select row_no,
    case campaign when 'click' then 'DLH-H2O' when 'view' then 'MMS' when 'error' then 'NOAA-H2O' else 'OTHER' end as instrument,
    case when campaign = 'error' then 'NOAAH2O_20140216' else source_file end as stem from obs"""

# --------------------------------------------------------------------- ingestion
_ROW = f"{AT} as row_no"
_QTY = "case when l_linenumber <> 3 then l_quantity end"
_DISC = "case when l_linenumber <> 6 then l_discount end"
ORACLE |= {
    "ingest_icartt": f"""select {supplier_file('.ict')} as source_file, {_ROW}, {clock_after('2001-02-03', 'l_orderkey')} as stamp,
        {_QTY} as qty, case when l_linenumber <> 5 then l_extendedprice end as price, {_DISC} as disc, cast(null as double) as gone
        from {LINES_OK} where l_linenumber <> 7""",
    "ingest_cells": f"""select {supplier_file('.ict')} as source_file, {_ROW}, cast(4 as bigint) as n_cells, {_QTY} as qty, {_DISC} as disc
        from {LINES_OK} where l_linenumber <> 7""",
    "ingest_bad_rows": f"""select {supplier_file('.ict')} as source_file, {_ROW}, concat_ws(', ', cast(l_orderkey as varchar), cast(l_quantity as varchar),
        cast(l_extendedprice as varchar), cast(l_discount as varchar), '1') as value from {LINES_OK} where l_linenumber = 7""",
    "ingest_file_errors": """select concat('S', cast(s_suppkey as varchar), '.ict') as file_name, case s_suppkey % 5
        when 0 then 'no table header found' when 1 then 'no flight date' else 'repeated column name' end as error from supplier where s_suppkey % 5 <= 2""",
    "ingest_whitespace": f"""select {supplier_file('.dat')} as source_file, {_ROW}, {clock_after('2002-07-09', 'l_orderkey')} as stamp,
        case when l_linenumber <> 2 then l_quantity end as tair, l_tax as frost from {LINES_OK}""",
    "ingest_unit_names": f"""select {supplier_file('.jlh')} as source_file, {_ROW}, {clock_after('2002-07-09', 'l_orderkey')} as stamp,
        l_quantity as t_k, l_tax as rh from {LINES_OK}""",
    "ingest_fixed_names": f"""select {supplier_file('.und')} as source_file, {_ROW}, {clock_after('2015-11-12', 'l_orderkey')} as stamp,
        l_quantity as tair, l_tax as frost, l_discount as alt, cast(null as double) as rh from {LINES_OK}""",
    "ingest_scaled_table": f"""select {supplier_file('.mms')} as source_file, {_ROW}, {clock_after('2002-07-09', 'l_orderkey')} as stamp,
        {r6(f"case when l_linenumber <> 2 then trunc(l_quantity)*{dbl(0.1)} end")} as alt, {r6(f"l_partkey*{dbl(0.01)}")} as lat,
        {r6(f"case when l_suppkey <> 5 then l_suppkey*{dbl(0.001)} end")} as lon from {LINES_OK}""",
    "ingest_header_scan": f"""select concat('2014_05_06_', {supplier_file('.iphex')}) as source_file, {_ROW}, {clock_after('2014-05-06', 'l_orderkey')} as stamp,
        l_quantity as tair, l_tax as frost, l_extendedprice as pres, cast(null as double) as lat from {LINES_OK}""",
    "ingest_repeated_names": f"""select {supplier_file('.txt')} as source_file, {_ROW},
        cast(date '2008-04-03' as timestamp) + to_seconds((l_orderkey % 24)*3600 + (case when l_linenumber <> 4 then 30 else 0 end)*60 + l_linenumber) as stamp,
        l_quantity as rh, case when l_linenumber <> 2 then l_tax end as tair, cast(1013 as double) as pres, cast(77 as double) as das_hh from {LINES_OK}""",
    "ingest_best_header": f"""select concat('ESCAPE-Page0_Learjet_20220617_R', cast(l_suppkey as varchar), '.ict') as source_file, {_ROW},
        {clock_after('2022-06-17', 'l_orderkey')} as stamp, l_quantity as temp, l_tax as dew, l_extendedprice as pres, cast(l_partkey as double) as alt,
        cast(10 as double) as lat, cast(20 as double) as lon from {LINES_OK} where l_suppkey % 7 <> 0 and l_returnflag not in ('A', 'R')""",
    "ingest_fixed_binary": f"""with x as (select *, cast(l_linenumber*1000 as bigint) as s, (l_partkey + 90000)/1000 - 100 as f,
          trunc((l_quantity + 100)*1000)/1000 - 100 as t from lineitem)
        select concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as source_file,
          make_timestamp(2000 + cast(year(l_shipdate) as bigint) % 100, month(l_shipdate), day(l_shipdate), 0, 0, 0) + to_seconds(s) as stamp,
          {r6('t')} as tair, {r6(si_mk('f', 't'))} as si, {r6('round(l_extendedprice*10)/1000 - 100')} as alt_m, cast(0 as double) as last_field from x""",
    "ingest_binary_gzip": f"""with x as (select concat(cast(l_suppkey as varchar), '-', cast(l_orderkey // 200000 as varchar)) as source_file, l_suppkey % 7 as kind,
          trunc((l_quantity + 100)*1000)/1000 - 100 as t from lineitem)
        select source_file, count(*) filter (where kind > 1) as n_rows, case when kind > 1 then count(*) - 1 end as last_row,
          {r6('sum(t) filter (where kind > 1)')} as tair_sum, true as in_order,
          case kind when 0 then 'length is not a whole number of records' when 1 then 'cannot unpack' end as error from x group by source_file, kind""",
}

# ------------------------------------------------ whole campaigns from raw files
_MC3E = """select l_orderkey, l_linenumber, -l_quantity as tair, case when l_linenumber <> 2 then -l_tax end as frost,
    cast(l_linenumber as double) as lat, -cast(l_linenumber as double) as lon, cast(l_partkey as double) as alt, l_suppkey % 7 = 0 as bad
    from lineitem"""
ORACLE |= {
    "campaign_mc3e": f"""select {clock_after('2011-04-25', 'l_orderkey')} as stamp, 'MC3E' as "Campaign", tair as "Tair_C",
        {r6(si_mk('frost', 'tair'))} as "Si", lat as "Lat", lon as "Lon", alt as "Alt_m"
        from ({_MC3E}) where not bad and l_linenumber <> 7""",
    "harmonise_report": """with s as (select l_suppkey % 7 = 0 as bad, count(*) filter (l_linenumber <> 7) as good,
          count(*) filter (l_linenumber = 7) as corrupt from lineitem group by l_suppkey, l_orderkey // 200000)
        select x as "Campaign", cast(sum(good) filter (not bad) as bigint) as n_rows, count(*) filter (bad) as n_errors,
          cast(sum(corrupt) filter (not bad) as bigint) as n_corrupt, cast(1 as bigint) as n_failed
        from s, (values ('MC3E'), ('SECOND')) v(x) group by x""",
}

_CHOICE = f"""select {supplier_file('.ict')} as file_name, s_suppkey % 7 = 0 as bad, s_suppkey % 3 as kind, * from {LINES_OK}"""
ORACLE |= {
    "ingest_quoted": f"""select {supplier_file('.ict')} as source_file, {_ROW}, cast(l_orderkey as double) as time, l_extendedprice as price,
        case l_linenumber when 2 then 'a, b' when 3 then 'x "y", z' when 4 then '"open' when 5 then 'p "q"' when 6 then '' else 'plain' end as note
        from {LINES_OK} where l_linenumber <> 7""",
    "late_column_choice": f"""select file_name as source_file, {_ROW}, cast(l_orderkey as double) as time,
        case kind when 2 then l_quantity when 0 then l_tax end as lat, case kind when 1 then l_tax when 0 then l_quantity end as lon,
        cast(null as double) as alt from ({_CHOICE}) where not bad and l_linenumber <> 7""",
    "campaign_counters": f"""with f as (select concat('S', cast(s_suppkey as varchar), '.ict') as file_name, s_suppkey % 7 = 0 as bad from supplier),
          n as (select file_name, count(*) filter (l_linenumber <> 7) as n_rows, count(*) filter (l_linenumber = 7) as n_corrupt
          from ({_CHOICE}) where not bad group by file_name)
        select file_name, nullif(n_rows, 0) as n_rows, case when bad then 'no flight date' end as error, nullif(n_corrupt, 0) as n_corrupt
        from f left join n using (file_name) where bad or n_rows > 0 or n_corrupt > 0""",
    "ingest_unreadable": """with f as (select l_suppkey % 7 = 0 as bad, count(*) filter (l_linenumber <> 7) as good
          from lineitem group by l_suppkey, l_orderkey // 200000),
        e as (select 'file cannot be read' as error, cast(1 as bigint) as n_errors
          union all select 'no table header found', count(*) from f where bad having count(*) > 0)
        select 'MC3E' as "Campaign", (select cast(sum(good) as bigint) from f where not bad) as n_rows, error, n_errors from e""",
}

ORACLE["harmonise_run"] = f"""select x as "Campaign", count(*) as n_rows, min({clock_after('2011-04-25', 'l_orderkey')}) as first,
    {r6('avg(tair)')} as mean_t, cast(1 as bigint) as n_failed
    from ({_MC3E}), (values ('MC3E'), ('SECOND')) v(x) where not bad and l_linenumber <> 7 group by x"""
