"""Fixed schemas and the helper that conforms a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# fixed values: columns of the event store, in store order
EVENT_COLUMNS = [
    "unique_key", "created_date", "closed_date", "resolution_action_updated_date",
    "complaint_type", "descriptor", "status", "resolution_description",
    "open_data_channel_type", "location_type", "incident_address", "street_name",
    "cross_street_1", "cross_street_2", "intersection_street_1", "intersection_street_2",
    "address_type", "incident_zip", "borough", "community_board", "police_precinct",
    "latitude", "longitude",
]
EVENT_TIMES = ["created_date", "closed_date", "resolution_action_updated_date"]
EVENT_NUMBERS = ["latitude", "longitude"]
# fixed values: text attributes of a line feature
LINE_TEXT = ["segmentid", "status", "facilitycl", "onoffst", "ft_facilit", "tf_facilit", "boro", "bikeid",
             "prevbikeid", "street", "fromstreet", "tostreet", "allclasses", "ft2facilit", "tf2facilit", "bikedir",
             "lanecount", "grnwy", "spur"]
# fixed values: columns of a lot row
LOT_COLUMNS = ["bbl", "version", "borough", "landuse", "bldgclass", "lotfront", "bldgfront",
               "comarea", "retailarea", "officearea", "latitude", "longitude"]
LOT_NUMBERS = ["lotfront", "bldgfront", "comarea", "retailarea", "officearea", "latitude", "longitude"]
# fixed values: the two header layouts of trip files, as role -> column
TRIP_LAYOUTS = [
    {"started": "started_at", "ended": "ended_at", "start_lat": "start_lat", "start_lng": "start_lng",
     "end_lat": "end_lat", "end_lng": "end_lng"},
    {"started": "starttime", "ended": "stoptime", "start_lat": "start station latitude",
     "start_lng": "start station longitude", "end_lat": "end station latitude",
     "end_lng": "end station longitude"},
]


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def event_schema() -> T.StructType:
    def kind(c: str) -> T.DataType:
        return (T.TimestampNTZType() if c in EVENT_TIMES
                else T.DoubleType() if c in EVENT_NUMBERS else T.StringType())
    return T.StructType([T.StructField(c, kind(c)) for c in EVENT_COLUMNS] + [
        T.StructField("source_dataset", T.StringType()), T.StructField("ingested_at", T.TimestampType())])


GRID_SCHEMA = T.StructType([
    T.StructField("month", T.StringType()), T.StructField("grid_lat", T.DoubleType()),
    T.StructField("grid_lon", T.DoubleType()), T.StructField("n", T.LongType()),
    T.StructField("month_complete", T.BooleanType()), T.StructField("source_dataset", T.StringType()),
    T.StructField("ingested_at", T.TimestampType())])

def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order; absent ones become typed nulls, present ones are cast."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
