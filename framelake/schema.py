"""Declared schemas of the tables, and the check that operators make on entry (no job runs)."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FRAMES = "stack_id long, frame long, ts timestamp, height int, width int, dtype string, px array<double>"
TILES = "stack_id long, frame long, ty int, tx int, y0 int, x0 int, h int, w int, halo int, px array<double>"
PIXELS = "stack_id long, frame long, y int, x int, v double"
POINTS = "stack_id long, frame long, point_id long, y double, x double, intensity double"
PAIRS = "stack_id long, frame long, point_id long, nbr_id long, dy double, dx double, axis int"
FIELDS = "stack_id long, frame long, y double, x double, exx double, eyy double, exy double, rot double"
ROIS = "roi_id long, vertex int, y double, x double"
REGIONS = "stack_id long, frame long, label long, area_px long, cy double, cx double, y_min int, x_min int, y_max int, x_max int"
PATTERNS = "scan_id long, sy int, sx int, kh int, kw int, px array<double>"
SPECTRA = "scan_id long, sy int, sx int, kind string, e0 double, de double, counts array<double>"
REFERENCES = "ref_id int, name string, e0 double, de double, counts array<double>"
CALIB = "stack_id long, nm_per_px double, s_per_frame double"
MANIFEST = "run_id string, operator string, version string, input string, params map<string,string>, units map<string,string>, started timestamp"


def require(df: DataFrame, schema: str, *names: str) -> DataFrame:
    """Raises unless df has the named columns (default: all) with the declared types; extra columns are allowed."""
    have = {f.name: f.dataType for f in df.schema}
    for field in T.StructType.fromDDL(schema):
        if names and field.name not in names:
            continue
        if field.name not in have:
            raise ValueError(f"column {field.name} is missing")
        if have[field.name].simpleString() != field.dataType.simpleString():
            raise TypeError(f"column {field.name} is {have[field.name].simpleString()}, not {field.dataType.simpleString()}")
    return df
