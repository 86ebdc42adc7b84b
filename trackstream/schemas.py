"""Declared schemas of the records that the operators exchange; nothing is inferred."""

LOCATION = (
    "event_id long, driver_id long, event_ms long, latitude double, longitude double, "
    "speed_kph double, heading_degrees int, vehicle_type string"
)
#: The first version of the location record, before kinematics were added.
LOCATION_V1 = "event_id long, driver_id long, event_ms long, latitude double, longitude double"
FENCE = "id long, name string, type string, polygonWkt string"
ORDER_ROW = "id long, customer_id long, status string, total_amount string"
#: Envelopes of any table: images as maps from column to text.
ENVELOPE_ANY = "before map<string,string>, after map<string,string>, source struct<table:string,lsn:long,snapshot:string>, op string, ts_ms long"
#: Envelopes of any table without their images.
ENVELOPE_BARE = "source struct<table:string,lsn:long,snapshot:string>, op string, ts_ms long"
ENVELOPE = (
    f"before struct<{ORDER_ROW.replace(' ', ':').replace(',:', ',')}>, after struct<{ORDER_ROW.replace(' ', ':').replace(',:', ',')}>, "
    "source struct<table:string,lsn:long,snapshot:string>, op string, ts_ms long"
)


def envelope(before: list[str], after: list[str]) -> str:
    """``ENVELOPE`` with only the named columns of the order images: what is not named is not parsed."""
    kinds = dict(f.split() for f in ORDER_ROW.split(", "))
    images = [f"{name} struct<{','.join(f'{c}:{kinds[c]}' for c in columns)}>" for name, columns in (("before", before), ("after", after))]
    return f"{', '.join(images)}, source struct<table:string,lsn:long,snapshot:string>, op string, ts_ms long"
