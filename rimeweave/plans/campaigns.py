"""The campaign pipelines: raw files to the standard table.

Each pipeline is ``(spark, spec) -> DataFrame`` and lazy, apart from reading
the distinct header names where a column is chosen over a whole campaign.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import clock, masks, names as N, numeric, thermo
from ..functions.text import strip
from ..operators import align, filters, guards
from ..operators.asof import nearest_asof, nearest_asof_fold
from ..operators.project import joined_sources, standard_projection, union_all
from ..sources import formats as fm
from ..sources.files import folder_of, stem_of
from ..sources.records import open_records
from ..sources.tables import TextTables, open_files
from ..specs import (
    AIRS_II_VARIABLES, ARM_RECORD, ATTREX_TIME_FALLBACKS, COMMON_SENTINELS, ESCAPE_CANDIDATES, ESCAPE_DATE_KEYS,
    ESCAPE_SENTINELS, FROST_MARGIN, ICARTT_SENTINELS, ICE_L_VARIABLES, INSTRUMENT_TIME, INSTRUMENT_TOLERANCE,
    IPHEX_SENTINELS, ISDAC_SENTINELS, MACPEX_POSITION, MACPEX_SENTINELS, MACPEX_TIME, MACPEX_TIME_FALLBACKS,
    MACPEX_VAPOUR, OLYMPEX_TABLE, POSIDON_POSITION_SCALE, POSITION_TABLE, POSITION_TOLERANCE, RAW_PRESSURE_SCALE,
    RAW_TEMPERATURE_SCALE, CampaignSpec,
)

# -------------------------------------------------------------------- formats

ICARTT = fm.TableFormat(names=fm.comma_names, date=fm.date_from_comma_line)
NAMES_BEFORE_LAST = fm.TableFormat(
    header=fm.CountedHeader(names_back=2), blank_separated=True, names=fm.clean_blank_names, date=fm.date_from_blank_line
)
NAMES_WITH_UNITS = fm.TableFormat(blank_separated=True, names=fm.unit_names, date=fm.date_from_blank_line)
OLYMPEX_FORMAT = fm.TableFormat(blank_separated=True, fixed_names=OLYMPEX_TABLE, date=fm.date_from_blank_line)
POSITION_FORMAT = fm.TableFormat(
    blank_separated=True, fixed_names=POSITION_TABLE, date=fm.date_from_blank_line, scale_line=4, missing_line=5
)
IPHEX_FORMAT = fm.TableFormat(
    header=fm.ScannedHeader(lambda l: strip(l).startswith("Time") & l.contains("Air_Temp"), skip=2),
    blank_separated=True,
    names=fm.blank_names,
    date=fm.date_from_name(r"^(\d+_\d+_\d+)[_.]", "y_M_d"),
    date_required=False,
    required=("FrostPoint", "Air_Temp", "STATIC_PR"),
)
ISDAC_FORMAT = fm.TableFormat(
    header=fm.ScannedHeader(lambda l: strip(l).startswith("HH,MM,SS"), skip=3),
    names=fm.unique_comma_names,
    date=fm.date_from_text,
    date_required=False,
    required=("ReHuI", "RSTem", "NPres"),
)
ESCAPE_FORMAT = fm.TableFormat(
    header=fm.WidestHeader("Time_Start", least_columns=8),
    names=fm.dotted_comma_names,
    date=fm.date_from_name_or_metadata(r"(?i)ESCAPE-Page0_Learjet_(\d{8})_R\d+\.ict$", "yyyyMMdd", ESCAPE_DATE_KEYS),
    date_required=False,
    metadata=True,
)


# -------------------------------------------------------------------- helpers

def _position_names(names: Sequence[str], altitude: Sequence[str] = ("alt",)) -> dict[str, str]:
    found = {
        "lat": N.pick_containing(names, "lat"),
        "lon": N.pick_containing(names, "lon"),
        "alt": N.pick_containing(names, *altitude),
    }
    return {out: name for out, name in found.items() if name}


def _position_roles(altitude: Sequence[str] = ("alt",)) -> dict[str, Callable[[Column], Column]]:
    """Tests of lower-case names for the three position columns, which are chosen over all files."""

    def containing(*tokens: str) -> Callable[[Column], Column]:
        return lambda name: name.rlike("|".join(tokens))

    return {"lat": containing("lat"), "lon": containing("lon"), "alt": containing(*altitude)}


def _timestamp(df: DataFrame, seconds: str) -> DataFrame:
    return df.withColumn("Timestamp", clock.seconds_after(F.col("flight_date"), F.col(seconds)))


_POSITION = {"Lat": ["lat"], "Lon": ["lon"], "Alt_m": ["alt"]}


def _standard(df: DataFrame, spec: CampaignSpec, temperature: str) -> DataFrame:
    return standard_projection(
        df, spec.name,
        {"Timestamp": ["Timestamp"], "Tair_C": [temperature], "Si": ["Si"], "source_file": ["source_file"], **_POSITION},
    )


# ------------------------------------------------------- fixed binary records

def arm(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    records = open_records(spark, spec.path, ARM_RECORD, spec.glob).filter(F.col("error").isNull())
    value = {c: numeric.packed_decimal(F.col(c)) for c in ARM_RECORD[1:]}
    stamp = clock.seconds_after(clock.yymmdd_to_date(F.col("Date")), value["Time_sec"])
    si = thermo.si_from_frost_point(value["Frost_Point_Cryo_C"], value["Air_Temp_Rosemount_C"])
    return standard_projection(
        records, spec.name,
        {
            "Timestamp": stamp, "Tair_C": value["Air_Temp_Rosemount_C"], "Si": si, "Lat": value["GPS_Lat_deg"],
            "Lon": value["GPS_Lon_deg"], "Alt_m": value["GPS_Alt_m"], "source_file": F.col("source_file"),
        },
    )


# ------------------------------------------- single-instrument tables, no guards

def mc3e(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    tables = open_files(spark, spec.path, NAMES_BEFORE_LAST, spec.glob)
    wanted = {"time": "Time", "tair": "Air_Temp", "frost": "FrostPoint"}
    rows = tables.late_rows(wanted, _position_roles(), COMMON_SENTINELS, spec.options.get("unmasked", ()))
    df = _timestamp(rows, "time")
    df = df.withColumn("Si", thermo.si_from_frost_point(F.col("frost"), F.col("tair")))
    return _standard(df, spec, "tair")


def midcix(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    tables = open_files(spark, spec.path, NAMES_WITH_UNITS, spec.glob, require=_has_ut())
    wanted = {"time": _ut_name, "t_k": "T_K", "rh": "RH"}
    df = _timestamp(tables.late_rows(wanted, _position_roles(("alt", "z")), COMMON_SENTINELS), "time")
    df = df.withColumns(
        {"Si": thermo.si_from_rh(F.col("rh")), "tair": numeric.kelvin_to_celsius(F.col("t_k"))}
    )
    return _standard(df, spec, "tair")


def olympex(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    tables = open_files(spark, spec.path, OLYMPEX_FORMAT, spec.glob)
    wanted = {
        "time": "Time", "tair": "Air_Temp", "frost": "FrostPoint", "lat": "POS_Lat", "lon": "POS_Lon", "alt": "POS_Alt",
    }
    df = _timestamp(tables.rows(wanted, sentinels=COMMON_SENTINELS), "time")
    df = df.withColumn("Si", thermo.si_from_frost_point(F.col("frost"), F.col("tair")))
    return _standard(df, spec, "tair")


def _ut_name(names: Column) -> Column:
    return N.first_where(names, lambda n: F.lower(n).startswith("ut"))


def _has_ut() -> tuple[Column, str]:
    """Files without a UT column cannot be placed in time."""
    return _ut_name(F.col("names")).isNotNull(), "no UT column"


def crystal_face_nasa(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    """Hygrometer files; with the option ``position_path`` also positions by as-of join."""
    tables = open_files(spark, spec.path, NAMES_WITH_UNITS, spec.glob, require=_has_ut())
    wanted: dict = {
        "time": _ut_name,
        "rh": lambda ns: N.first_where(ns, lambda n: F.lower(n).contains("rh")),
        "t_k": lambda ns: N.first_where(ns, lambda n: F.lower(n).isin("t_k", "t")),
    }
    position_path = spec.options.get("position_path")
    roles = {} if position_path else _position_roles(("alt", "z"))
    df = _timestamp(tables.late_rows(wanted, roles), "time").withColumns(
        {"Si": thermo.si_from_rh(F.col("rh")), "tair": numeric.kelvin_to_celsius(F.col("t_k"))}
    )
    if position_path:
        df = nearest_asof(
            df.select("source_file", "Timestamp", "tair", "Si"), positions(spark, position_path), "Timestamp",
            spec.options.get("tolerance", POSITION_TOLERANCE), tiebreak=["position_file", "row_no"],
        )
    return _standard(df, spec, "tair")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Position files whose header carries scale factors and missing flags."""
    tables = open_files(spark, path, POSITION_FORMAT)
    rows = tables.rows({"time": "UT", "lat": "LAT", "lon": "LONG", "alt": "P_ALT"})
    return _timestamp(rows, "time").select(
        F.col("source_file").alias("position_file"), "row_no", "Timestamp", "lat", "lon", "alt"
    )


def crystal_face_und(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    """Humidity files, each with the temperatures of its paired meteorology file."""
    tables = open_files(spark, spec.path, NAMES_BEFORE_LAST, spec.glob)
    humidity = tables.only(F.col("file_name").endswith("MIS.CIT"))
    weather = tables.only(F.col("file_name").endswith("MET.CIT"))
    left = _timestamp(humidity.late_rows({"time": "Time", "rh": "RH"}, _position_roles(), COMMON_SENTINELS), "time")
    left = left.withColumn("pair", F.col("source_file"))
    right = weather.rows(
        {"time": "Time", "tair": lambda ns: N.first_where(ns, lambda n: n.startswith("Air_Temp"))},
        sentinels=COMMON_SENTINELS,
        carry={"has_tair": F.exists("names", lambda n: n.startswith("Air_Temp"))},
    ).filter("has_tair")
    right = _timestamp(right, "time").select(
        F.regexp_replace("source_file", "MET\\.CIT", "MIS.CIT").alias("pair"), "Timestamp", "tair"
    )
    df = align.left_join_nullsafe(left, right, ["pair"], "Timestamp")
    return _standard(df.withColumn("Si", thermo.si_from_rh(F.col("rh"))), spec, "tair")


# -------------------------------------------------- tables with unit guards

@dataclass(frozen=True)
class Refinement:
    """What happens between sentinel masking and Si, in this order."""

    guards: Sequence[guards.Guard]
    ranges: Mapping[str, tuple[float, float]]
    group: Sequence[str] = ("source_file",)


def refine(df: DataFrame, rules: Refinement) -> DataFrame:
    """Guards by group, then ranges."""
    return in_range(guards.apply_guards(df, rules.guards, rules.group), rules)


def in_range(df: DataFrame, rules: Refinement) -> DataFrame:
    return df.withColumns({c: masks.keep_range(F.col(c), *r) for c, r in rules.ranges.items() if c in df.columns})


_GEO = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "alt": (-500.0, 25000.0)}

IPHEX_RULES = Refinement(
    guards=[guards.kelvin_guard("tair"), guards.kelvin_guard("frost"), guards.pascal_guard("pres")],
    ranges={"tair": (-95.0, 60.0), "frost": (-120.0, 40.0), "pres": (50.0, 1100.0), **_GEO},
)
ISDAC_RULES = Refinement(
    guards=[guards.kelvin_guard("tair"), guards.kelvin_guard("frost"), guards.pascal_guard("pres")],
    ranges={"tair": (-95.0, 60.0), "pres": (50.0, 1100.0), "rh": (-20.0, 250.0), "frost": (-120.0, 40.0), **_GEO},
)
ESCAPE_RULES = Refinement(
    guards=[guards.kelvin_guard("temp"), guards.kelvin_guard("dew"), guards.feet_guard("alt")],
    ranges={"temp": (-95.0, 60.0), "dew": (-110.0, 40.0), "pres": (50.0, 1100.0), **_GEO},
)
ICE_L_RULES = Refinement(
    guards=[guards.kelvin_guard("atx")],
    ranges={"atx": (-95.0, 60.0), "psxc": (50.0, 1100.0), "rh": (-20.0, 200.0), **_GEO},
)
SI_RANGE = (-1.0, 5.0)


def iphex(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    tables = open_files(spark, spec.path, IPHEX_FORMAT, spec.glob, exclude="Combined")
    wanted = {
        "time": "Time", "tair": "Air_Temp", "frost": "FrostPoint", "pres": "STATIC_PR",
        "lat": "POS_Lat", "lon": "POS_Lon", "alt": "POS_Alt",
    }
    df = in_range(tables.guarded_rows(wanted, IPHEX_RULES.guards, IPHEX_SENTINELS), IPHEX_RULES)
    df = df.withColumn("frost", masks.drop_if_above(F.col("frost"), F.col("tair"), FROST_MARGIN))
    si = thermo.si_from_frost_point_tetens(F.col("frost"), F.col("tair"))
    return _standard(_timestamp(df.withColumn("Si", masks.keep_range(si, *SI_RANGE)), "time"), spec, "tair")


def isdac(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    tables = open_files(spark, spec.path, ISDAC_FORMAT, spec.glob, exclude="Combined")
    wanted = {
        "hh": "HH", "mm": "MM", "ss": "SS", "tair": "RSTem", "pres": "NPres", "rh": "ReHuI", "frost": "LicFro",
        "lat": "MastrLAT", "lon": "MasterLON", "alt": "PreAlt",
    }
    df = in_range(tables.guarded_rows(wanted, ISDAC_RULES.guards, ISDAC_SENTINELS), ISDAC_RULES)
    df = df.withColumns(
        {
            "Si": masks.keep_range(thermo.si_from_rh(F.col("rh")), *SI_RANGE),
            "Timestamp": clock.hms_after(F.col("flight_date"), F.col("hh"), F.col("mm"), F.col("ss")),
        }
    )
    return _standard(df, spec, "tair")


def _quality_names(names: Column) -> Column:
    def is_quality(name: Column) -> Column:
        found = F.lit(False)
        for token in filters.QUALITY_COLUMN_TOKENS:
            found = found | F.lower(N.clean_name(name)).contains(token)
        return found

    return F.filter(names, is_quality)


def escape(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    tables = open_files(spark, spec.path, ESCAPE_FORMAT, spec.glob, recursive=True)
    wanted = {out: (lambda ns, c=c: N.three_tier(ns, c)) for out, c in ESCAPE_CANDIDATES.items()}
    alt_key = F.lower(N.clean_name(N.three_tier(F.col("names"), ESCAPE_CANDIDATES["alt"])))
    told_feet = F.lower(F.concat_ws(" ", F.map_values("metadata"))).contains("feet")
    in_feet = alt_key.contains("ft") | alt_key.contains("feet") | (alt_key.contains("palt") & told_feet)
    df = tables.guarded_rows(
        wanted, ESCAPE_RULES.guards, ESCAPE_SENTINELS, forced={"alt": in_feet}, quality=_quality_names
    )
    df = in_range(df, ESCAPE_RULES)
    si = thermo.si_from_frost_point(F.col("dew"), F.col("temp"))
    return _standard(_timestamp(df.withColumn("Si", masks.keep_range(si, *SI_RANGE)), "time"), spec, "temp")


# ------------------------------------------------------------ gridded variables

def _variables(spark: SparkSession, spec: CampaignSpec) -> tuple[DataFrame, DataFrame]:
    """``axis`` and ``values`` tables below the campaign path."""
    axis = spark.read.parquet(f"{spec.path}/axis")
    values = spark.read.parquet(f"{spec.path}/values")
    return axis.withColumn("Timestamp", F.col("Timestamp").cast("timestamp")), values


def airs_ii(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    axis, values = _variables(spark, spec)
    df = align.grid_rows(axis, values, AIRS_II_VARIABLES, required=("rh", "atx"), same_length=("lat", "lon", "alt"))
    df = filters.keep_humidity(df, "rh")
    return _standard(df.withColumn("Si", thermo.si_from_rh(F.col("rh"))), spec, "atx")


def ice_l(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    axis, values = _variables(spark, spec)
    df = refine(align.grid_rows(axis, values, ICE_L_VARIABLES, required=("atx", "psxc", "rh")), ICE_L_RULES)
    si = masks.keep_range(thermo.si_from_rh(F.col("rh")), *SI_RANGE)
    return _standard(df.withColumn("Si", si), spec, "atx")


# ------------------------------------------------------- several instruments

@dataclass(frozen=True)
class Instruments:
    """The instruments of a campaign and the merged column names they offer."""

    tables: TextTables
    instrument: Column              # over ``path`` and ``file_name``
    prefix_of: Callable[[str], str]
    order: list[str]                # primary first
    names: dict[str, list[str]]     # raw names per instrument
    time_of: Callable[[str], Callable[[Column], Column]]
    sentinels: Sequence[float]
    mask_time: bool = True
    always_prefix: bool = False     # also where a name already starts with the prefix

    def merged_names(self) -> list[str]:
        return [m for i in self.order for m in self._merged(i)]

    def _merged(self, instrument: str) -> dict[str, str]:
        prefix = self.prefix_of(instrument)
        return {N.with_prefix(n, prefix, self.always_prefix): n for n in self.names[instrument]}

    def stream(self, instrument: str, merged: Sequence[str], staging: str | None) -> DataFrame:
        """Rows of one instrument: time stamp and the wanted columns that it has.

        The joins read a stream more than once.  With a ``staging`` folder, which
        belongs to one plan alone, it is parsed once and kept there as parquet.
        """
        mine = self._merged(instrument)
        wanted: dict = {m: mine[m] for m in merged if m in mine}
        tables = self.tables.only(self.instrument == F.lit(instrument))
        rows = tables.rows(
            {**wanted, "_seconds": self.time_of(instrument)}, sentinels=self.sentinels,
            unmasked=() if self.mask_time else ("_seconds",),
        )
        rows = rows.select(
            clock.seconds_after(F.col("flight_date"), F.col("_seconds")).alias("Timestamp"), "source_file", "row_no",
            *[F.col(f"`{m}`") for m in wanted],
        )
        if not staging:
            return rows
        place = f"{staging}/{quote(instrument, safe='')}"
        # parquet names may not hold some of the characters that columns have
        plain = [f"c{i}" for i in range(len(rows.columns))]
        rows.toDF(*plain).write.parquet(place)
        return rows.sparkSession.read.parquet(place).toDF(*rows.columns)

    def merge(self, merged: Sequence[str], options: Mapping[str, Any]) -> DataFrame:
        """All instruments on the times of the first one.

        Only the wanted columns enter the joins: a name that nobody uses is
        never read out of its file.
        """
        tolerance, staging = options.get("tolerance", INSTRUMENT_TOLERANCE), options.get("staging_path")
        if staging:  # campaigns may share instrument names, and runs may share the folder
            staging = f"{staging.rstrip('/')}/{uuid4().hex}"
        streams = {i: self.stream(i, merged, staging) for i in self.order}
        primary = streams.pop(self.order[0])
        return nearest_asof_fold(primary, streams, "Timestamp", tolerance, tiebreak=["source_file", "row_no"])


def _survey_instruments(
    tables: TextTables, instrument: Column, primary: Callable[[list[str]], str], **kw
) -> Instruments:
    names = tables.column_names(instrument)
    if not names:
        raise ValueError("no instrument file could be parsed")
    found = sorted(names)
    first = primary(found)
    return Instruments(
        tables=tables, instrument=instrument, order=[first] + [i for i in found if i != first], names=names, **kw
    )


def _maybe(name: str | None) -> Column:
    return F.col(f"`{name}`") if name else F.lit(None).cast("double")


def attrex_instrument() -> Column:
    """Instrument from folder or file name; else the folder."""
    folder, stem = F.upper(folder_of(F.col("path"))), F.upper(stem_of(F.col("file_name")))
    result: Column | None = None
    for key in INSTRUMENT_TIME:
        test = folder.contains(key.upper()) | F.replace(stem, F.lit("-"), F.lit("")).contains(key.upper().replace("-", ""))
        result = F.when(test, F.lit(key)) if result is None else result.when(test, F.lit(key))
    return result.otherwise(folder_of(F.col("path")))


def attrex_merged(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    """Merged instruments with ``T_K, P_hPa, Si, Si_alt``."""
    tables = open_files(spark, spec.path, ICARTT, spec.glob, recursive=True)

    def time_of(instrument: str):
        preferred = F.lit(INSTRUMENT_TIME.get(instrument, "Time_Start"))
        return lambda names: N.time_column(names, preferred, ATTREX_TIME_FALLBACKS)

    inst = _survey_instruments(
        tables, attrex_instrument(), lambda found: spec.options.get("primary", found[0]),
        prefix_of=lambda i: i, time_of=time_of, sentinels=ICARTT_SENTINELS,
    )
    names = inst.merged_names()
    raw_t = N.pick_suffix(names, "mms", "_T")
    raw_p = N.pick_suffix(names, "mms", "_P")
    plain_t = None if raw_t else next((n for n in names if n == "T" or n.startswith("T_")), None)
    plain_p = None if raw_p else next((n for n in names if n == "P" or n.startswith("P_")), None)
    vapour = [n for n in names if "h2o" in n.lower() and "ppm" in n.lower()]
    dlh = N.pick_containing(vapour, "dlh")
    noaa = N.pick_containing(vapour, "noaa", "nw")
    first = dlh or noaa or (vapour[0] if vapour else None)
    other = noaa if first == dlh else dlh
    place = _position_names(names)
    wanted = [n for n in dict.fromkeys([raw_t, raw_p, plain_t, plain_p, first, other, *place.values()]) if n]
    df = inst.merge(wanted, spec.options)

    kelvin = numeric.affine(_maybe(raw_t), RAW_TEMPERATURE_SCALE) if raw_t else _maybe(plain_t)
    hpa = numeric.affine(_maybe(raw_p), RAW_PRESSURE_SCALE["ATTREX"]) if raw_p else _maybe(plain_p)
    df = df.withColumns({"T_K": kelvin, "P_hPa": hpa, "_q": masks.keep_positive(_maybe(first)), "_q2": masks.keep_positive(_maybe(other))})
    if plain_t:
        df = guards.apply_guards(df, [guards.celsius_to_kelvin_guard("T_K")], [])
    df = df.withColumns(
        {"T_K": masks.keep_range(F.col("T_K"), 150, 350), "P_hPa": masks.keep_half_open(F.col("P_hPa"), 0, 1100)}
    )

    def si(q: str) -> Column:
        return masks.keep_magnitude(thermo.si_from_ppmv(F.col(q), F.col("T_K"), F.col("P_hPa")), 10)

    return df.withColumns({"Si": si("_q"), "Si_alt": si("_q2"), **{o: _maybe(n) for o, n in place.items()}})


def attrex(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    return _multi_standard(attrex_merged(spark, spec), spec, "+")


def _multi_standard(df: DataFrame, spec: CampaignSpec, separator: str) -> DataFrame:
    sources = [c for c in df.columns if c.startswith("source_file")]
    return standard_projection(
        df, spec.name,
        {
            "Timestamp": F.col("Timestamp"), "Tair_C": numeric.kelvin_to_celsius(F.col("T_K")), "Si": F.col("Si"),
            "source_file": joined_sources(sources, separator), **_POSITION,
        },
    )


def macpex_merged(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    """Merged instruments with ``T_K, P_hPa, Si`` and ``Si_<source>`` for the other vapour sources."""
    source = spec.options.get("wv_source", "DLH")
    if source not in MACPEX_VAPOUR:
        raise ValueError(f"wv_source must be one of {list(MACPEX_VAPOUR)}, got '{source}'")
    tables = open_files(spark, spec.path, ICARTT, spec.glob, recursive=True)

    def primary(found: list[str]) -> str:
        return spec.options.get("primary") or next((i for i in found if i.startswith("MMS")), found[0])

    inst = _survey_instruments(
        tables, folder_of(F.col("path")), primary, prefix_of=lambda i: i, sentinels=MACPEX_SENTINELS,
        time_of=lambda i: lambda names: N.time_column(names, F.lit(MACPEX_TIME), MACPEX_TIME_FALLBACKS),
    )
    names = inst.merged_names()
    raw = {
        s: N.pick(names, [f"MMS-Met_{s}", f"MMS-MetData_{s}"]) or N.pick_suffix(names, "mms", f"_{s}") for s in ("T", "P")
    }
    vapour = {s: N.pick(names, c) for s, c in MACPEX_VAPOUR.items()}
    if vapour[source] is None:
        raise KeyError(f"no water-vapour column for source '{source}'")
    place = {
        o: N.pick(names, c) or N.pick_containing(names, t)
        for (o, c), t in zip(MACPEX_POSITION.items(), ("lat", "lon", "alt"))
    }
    wanted = [n for n in dict.fromkeys([*raw.values(), *vapour.values(), *place.values()]) if n]
    df = inst.merge(wanted, spec.options)

    def scaled(name: str | None, scale: float, bounds: tuple[float, float]) -> Column:
        value = masks.drop_scaled_flags(numeric.affine(_maybe(name), scale), MACPEX_SENTINELS, scale)
        return masks.keep_range(value, *bounds)

    df = df.withColumns(
        {
            "T_K": scaled(raw["T"], RAW_TEMPERATURE_SCALE, (150, 350)),
            "P_hPa": scaled(raw["P"], RAW_PRESSURE_SCALE["MACPEX"], (10, 1100)),
        }
    )

    def si(name: str) -> Column:
        q = masks.keep_positive(_maybe(name))
        return masks.keep_range(thermo.si_from_ppmv(q, F.col("T_K"), F.col("P_hPa")), -1, 1)

    results = {"Si": si(vapour[source])}
    results |= {f"Si_{s}": si(n) for s, n in vapour.items() if s != source and n}
    places = {o: _maybe(n) for o, n in zip(("lat", "lon", "alt"), place.values())}
    return df.withColumns({**results, **places})


def macpex(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    return _multi_standard(macpex_merged(spark, spec), spec, "|")


def posidon(spark: SparkSession, spec: CampaignSpec) -> DataFrame:
    folder = folder_of(F.col("path"))
    known: Column | None = None
    for key, time in INSTRUMENT_TIME.items():
        test = (folder == key) & F.array_contains("names", time)
        known = test if known is None else known | test
    tables = open_files(spark, spec.path, ICARTT, spec.glob, recursive=True).only(known)

    def time_of(instrument: str):
        times = F.array(*[F.lit(t) for t in INSTRUMENT_TIME.values()])
        folders = F.array(*[F.lit(f) for f in INSTRUMENT_TIME])
        return lambda names: F.get(times, (F.array_position(folders, folder_of(F.col("path"))) - 1).cast("int"))

    inst = _survey_instruments(
        tables, F.split(stem_of(F.col("file_name")), "_")[0], lambda found: spec.options.get("primary", found[0]),
        prefix_of=lambda i: i, time_of=time_of, sentinels=ICARTT_SENTINELS, mask_time=False, always_prefix=True,
    )
    names = inst.merged_names()
    # fixed values: the merged columns this campaign uses
    column = {
        "t": "MMS-1HZ_T", "p": "MMS-1HZ_P", "q": "DLH-H2O_H2O_ppmv",
        "lat": "MMS-1HZ_G_LAT", "lon": "MMS-1HZ_G_LONG", "alt": "MMS-1HZ_G_ALT",
    }
    have = {k: c if c in names else None for k, c in column.items()}
    df = inst.merge([c for c in have.values() if c], spec.options)
    kelvin = numeric.affine(_maybe(have["t"]), RAW_TEMPERATURE_SCALE)
    hpa = numeric.affine(_maybe(have["p"]), RAW_PRESSURE_SCALE["POSIDON"])
    si = masks.clip(thermo.si_from_ppmv(_maybe(have["q"]), kelvin, hpa, bound_temperature=False), -1, 1)
    place = {k: numeric.affine(_maybe(have[k]), s) for k, s in POSIDON_POSITION_SCALE.items()}
    return standard_projection(
        df, spec.name,
        {
            "Timestamp": F.col("Timestamp"), "Tair_C": numeric.kelvin_to_celsius(kelvin), "Si": si,
            "Lat": place["lat"], "Lon": place["lon"], "Alt_m": place["alt"],
        },
        extras={"Tair_K": kelvin, "Pressure_hPa": hpa},
    )


Pipeline = Callable[[SparkSession, CampaignSpec], DataFrame]

PIPELINES: dict[str, Pipeline] = {
    "ARM": arm,
    "CRYSTAL-FACE-NASA": crystal_face_nasa,
    "CRYSTAL-FACE-UND": crystal_face_und,
    "MC3E": mc3e,
    "MIDCIX": midcix,
    "OLYMPEX": olympex,
    "AIRS-II": airs_ii,
    "ATTREX": attrex,
    "IPHEX": iphex,
    "ISDAC": isdac,
    "POSIDON": posidon,
    "ESCAPE": escape,
    "ICE-L": ice_l,
    "MACPEX": macpex,
}
