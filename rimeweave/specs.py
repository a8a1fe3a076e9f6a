"""Fixed values of the campaigns and the campaign job specification."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

# ------------------------------------------------------- fixed values: fill flags

COMMON_SENTINELS = (
    999999.9999, 999.9999999, 9999.999999, 99999.99999, 99999999999, 999999,
    9.9999e30, 9.999e30, -9999, -9999.99, -7777, -7777.77, -8888, -8888.88,
)
ICARTT_SENTINELS = (-9999, -9999.99, -7777, -7777.77, -8888, -8888.88)
MACPEX_SENTINELS = (-9999, -9999.99, -7777, -7777.77, -8888, -8888.88, -999.99)
IPHEX_SENTINELS = (
    999999.9999, 999.9999999, 9999.999999, 99999.99999, 99999999999,
    9.9999e30, 9.999e30, -9999, -9999.99, -7777, -7777.77, -8888, -8888.88,
)
ISDAC_SENTINELS = (
    -8, -88, -888, -8888, -8.8, -88.8, -888.8, -8.88, -88.88, -888.88, -8.888, -88.888, -8.8888,
    -3000, -9999, -9999.99, -7777, -7777.77, 99999, 999999, 9.999e30, 9.9999e30,
)
ESCAPE_SENTINELS = (*COMMON_SENTINELS, -999)

# ---------------------------------------------- fixed values: columns of fixed tables

# 39 integers of one binary record
ARM_RECORD = (
    "Date", "Time_sec", "True_Air_Speed_m_s", "Wind_Speed_m_s", "Wind_Direction_deg", "INS_Heading_deg",
    "Pitch_deg", "Roll_deg", "Static_Pressure_mb", "Pressure_Altitude_m", "Air_Temp_Rosemount_C",
    "Dew_Point_EGG_C", "Dew_Point_Cryo_C", "Frost_Point_Cryo_C", "King_LWC_g_m3", "FSSP_LWC_g_m3",
    "Vertical_Wind_m_s", "Turbulence_eps", "Ozone_ppb", "CN_Conc_per_cm3", "INS_Latitude_deg",
    "INS_Longitude_deg", "GPS_Lat_deg", "GPS_Lon_deg", "GPS_Alt_m", "GPS_Ground_Speed_m_s",
    "FSSP_Conc_per_ml", "FSSP_Mean_Diam_um", "FSSP_Mean_Vol_Diam_um", "DC1_Conc_per_L", "DC1_Mean_Diam_um",
    "DC1_Mean_Vol_Diam_um", "DC2_Conc_per_L", "DC2_Mean_Diam_um", "DC2_Mean_Vol_Diam_um",
    "DC2_Shadow_Or_per_L", "DP2_Conc_per_L", "DP2_Mean_Diam_um", "DP2_Mean_Vol_Diam_um",
)
# 53 names of a table without a usable header line
OLYMPEX_TABLE = (
    "Time", "Air_Temp", "MachNo_N", "IAS", "TAS", "Press_Alt", "Pot_Temp_T1", "STATIC_PR", "DEWPT", "REL_HUM",
    "MixingRatio", "DewPoint", "FrostPoint", "RH", "IceMSOFreq", "TSG_Date", "POS_Roll", "POS_Pitch", "POS_Head",
    "POSZ_Acc", "POS_Lat", "POS_Lon", "POS_Alt", "POS_Spd", "POS_Trk", "Alpha", "Beta", "VERT_VEL", "Wind_Z",
    "Wind_M", "Wind_D", "TURB", "King_LWC_ad", "Nev_TWC", "Nev_LWCcor", "Nev_IWC", "CSI_M_Ratio", "CSI_CWC",
    "CDP_Conc", "CDP_LWC", "CDP_MenD", "CDP_VolDia", "CDP_EffRad", "2-DC_Conc", "2-DC_MenD", "2-DC_VolDia",
    "2-DC_EffRad", "Nt2DSHGT105", "Nt2DSH_all", "Nt2DSVGT105", "Nt2DSV_all", "Nt_HVPS3H", "Nt_HVPS3BV",
)
POSITION_TABLE = ("UT", "P_ALT", "LAT", "LONG", "TAS")

# ------------------------------------------------- fixed values: columns by candidate name

INSTRUMENT_TIME = {"DLH-H2O": "Time_UTC", "NOAA-H2O": "NW_UTC_s", "MMS": "TIME_UTC"}
ATTREX_TIME_FALLBACKS = ("Time_Start", "Time_Mid", "time")
MACPEX_TIME = "Time_Start"
MACPEX_TIME_FALLBACKS = ("Time_Start", "Time_Mid", "Time_Stop", "time_utc", "Time_UTC")
MACPEX_VAPOUR = {
    "DLH": ("DLH_H2O_ppmv", "DLH-H2O_H2O_ppmv", "H2O_ppmv"),
    "HWV": ("HWV_H2O", "H2O"),
    "JLH": ("JLH_H2O(v)_ppmv", "JLH-H2O_H2O(v)_ppmv", "H2O(v)_ppmv"),
}
MACPEX_POSITION = {
    "Lat": ("MMS-Met_LAT", "MMS-Met_Lat", "MMS-MetData_LAT", "MMS-MetData_Lat", "LAT", "Lat", "latitude"),
    "Lon": ("MMS-Met_LON", "MMS-Met_Lon", "MMS-MetData_LON", "MMS-MetData_Lon", "LON", "Lon", "longitude"),
    "Alt_m": ("MMS-Met_ALT", "MMS-Met_Alt", "MMS-MetData_ALT", "MMS-MetData_Alt", "ALT", "Alt", "ALTITUDE"),
}
ESCAPE_CANDIDATES = {
    "temp": ("Temp", "Temperature", "Air_Temp", "T"),
    "dew": ("Dew", "DewPoint", "Dew_Point", "Td"),
    "pres": ("Pressure", "Pres", "P", "Static_Pressure", "P_hPa"),
    "alt": ("Palt", "Alt", "Altitude", "GPS_Alt", "Press_Alt"),
    "lat": ("Lat", "Latitude", "GPS_Lat"),
    "lon": ("Long", "Lon", "Longitude", "GPS_Lon"),
    "time": ("Time_Start", "Time", "UTC", "Time_UTC"),
}
ESCAPE_DATE_KEYS = ("FlightDate", "Date", "Flight_Date")
AIRS_II_VARIABLES = {
    "rh": ("RHUM",), "atx": ("ATX",), "lat": ("LAT", "LATC"), "lon": ("LON", "LONC"), "alt": ("ALT", "GGALT"),
}
ICE_L_VARIABLES = {
    "atx": ("ATX",), "psxc": ("PSXC",), "rh": ("RHUM",),
    "lat": ("LAT", "LATC", "GGLAT"), "lon": ("LON", "LONC", "GGLON"), "alt": ("PALTF", "GGALT", "ALT", "PALT"),
}

# ----------------------------------------- fixed values: scale factors and physical bounds

RAW_TEMPERATURE_SCALE = 0.01
RAW_PRESSURE_SCALE = {"ATTREX": 0.01, "MACPEX": 0.1, "POSIDON": 0.01}
POSIDON_POSITION_SCALE = {"lat": 1e-5, "lon": 1e-5, "alt": 0.1}
FROST_MARGIN = 20.0
POSITION_TOLERANCE = 10.0
INSTRUMENT_TOLERANCE = 1.0

# ------------------------------------------------- fixed values: campaign input patterns

CAMPAIGN_PATTERNS = {
    "ARM": "*.t4archive.gz",
    "CRYSTAL-FACE-NASA": "*",
    "CRYSTAL-FACE-UND": "*.CIT",
    "MC3E": "*",
    "MIDCIX": "*",
    "OLYMPEX": "*",
    "AIRS-II": "*.parquet",
    "ATTREX": "*.ict",
    "IPHEX": "*.iphex",
    "ISDAC": "*.txt",
    "POSIDON": "*.ict",
    "ESCAPE": "ESCAPE-Page0_Learjet_*.ict",
    "ICE-L": "*.parquet",
    "MACPEX": "*.ict",
}


@dataclass(frozen=True)
class CampaignSpec:
    """One campaign of a harmonisation job.

    ``kind`` selects the pipeline (default: the one named like the campaign),
    so a new campaign in a known format needs no code.  Options:

    * ``position_path``: folder of position files (CRYSTAL-FACE-NASA)
    * ``primary``: instrument whose times lead the as-of joins
    * ``wv_source``: DLH, HWV or JLH (MACPEX)
    * ``tolerance``: seconds for the as-of joins
    * ``unmasked``: of ``time``, ``tair``, ``frost``, ``lat``, ``lon`` and ``alt`` those that hold no fill values (MC3E)
    * ``staging_path``: shared folder where parsed instrument streams are kept
      between the joins, so that raw text is parsed once
    """

    name: str
    path: str
    pattern: str | None = None
    kind: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)

    @property
    def pipeline(self) -> str:
        return self.kind or self.name

    @property
    def glob(self) -> str:
        return self.pattern or CAMPAIGN_PATTERNS.get(self.pipeline, "*")
