"""Feeds as DataFrames: raw documents in, typed rows out, with explicit schemas and no inference.

JSON feeds are read as whole documents (one row per file: ``path``, ``content``), so that an envelope that isn't the
feed's raises instead of reading as an empty feed, which would close every event.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.functions import units
from haulspark.functions.tags import coded_flag, codes, way_centre
from haulspark.functions.text import lookup

# Codes of the feeds.
AREAS = {
    "NUS": "US", "R10": "PADD1", "R1X": "PADD1A", "R1Y": "PADD1B", "R1Z": "PADD1C", "R20": "PADD2", "R30": "PADD3", "R40": "PADD4", "R50": "PADD5",
    "R5XCA": "PADD5_EX_CA", "SCA": "CA",
}
FIPS = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT", "10": "DE", "11": "DC", "12": "FL", "13": "GA", "15": "HI",
    "16": "ID", "17": "IL", "18": "IN", "19": "IA", "20": "KS", "21": "KY", "22": "LA", "23": "ME", "24": "MD", "25": "MA", "26": "MI", "27": "MN",
    "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH", "34": "NJ", "35": "NM", "36": "NY", "37": "NC", "38": "ND", "39": "OH",
    "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD", "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA",
    "54": "WV", "55": "WI", "56": "WY", "72": "PR", "78": "VI",
}
ALWAYS_OPEN = ["24/7", "Mo-Su 00:00-24:00"]
RESTRICTIONS = [("L10", "height_restriction_l10"), ("L11", "hazardous_material_restriction_"), ("L12", "other_restrictions_l12")]


class NotAFeed(ValueError):
    """The document is not this feed's; publishing it as empty would be wrong."""


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"))


def elements(docs: DataFrame, key: str, schema: str = "string") -> DataFrame:
    """One row per element of the array at a top-level key, as JSON text; raises where there is no such array."""
    inside = F.get_json_object("content", f"$.{key}")
    bad = docs.where(inside.isNull() | ~F.ltrim(inside).startswith("[")).select("path").take(1)
    if bad:
        raise NotAFeed(f"{bad[0]['path']}: no array at {key!r}")
    return docs.select("path", F.col("content").alias("document"), F.posexplode(F.from_json(inside, "array<string>")).alias("ordinal", "element"))


def _at(path: str, of: str | Column = "element") -> Column:
    return F.get_json_object(of if isinstance(of, Column) else F.col(of), f"$.{path}")


def _first(*paths: str) -> Column:
    return F.coalesce(*[F.nullif(_at(p), F.lit("")) for p in paths])


def _lon_lat(lat: str, lon: str) -> tuple[Column, Column]:
    point = _at("geometry.type") == "Point"
    x = F.when(point, _at("geometry.coordinates[0]")).otherwise(_at(f"properties.{lon}")).try_cast("double")
    y = F.when(point, _at("geometry.coordinates[1]")).otherwise(_at(f"properties.{lat}")).try_cast("double")
    return x, y


def geojson_wkt(geometry: Column) -> Column:
    """WKT of a GeoJSON geometry's text: points, lines and polygons, single and multiple; null for anything else."""
    kind = F.upper(F.get_json_object(geometry, "$.type"))
    raw = F.regexp_replace(F.get_json_object(geometry, "$.coordinates"), r"\s", "")
    pairs = F.regexp_replace(raw, r"\[(-?[0-9.eE+-]+),(-?[0-9.eE+-]+)(?:,[^\]]*)?\]", "$1 $2")
    body = F.translate(pairs, "[]", "()")
    body = F.when(kind == "POINT", F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)
    known = kind.isin("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
    too_short = kind.isin("LINESTRING", "MULTIPOINT") & ~body.contains(",") & (kind == "LINESTRING")
    return F.when(known & ~F.coalesce(too_short, F.lit(False)), F.concat(kind, F.lit(" "), body))


def multiline_wkt(geometry: Column) -> Column:
    """WKT of a GeoJSON line or lines as one MULTILINESTRING; parts of fewer than two points go, null if none is left."""
    kind, raw = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    parts = F.when(kind == "LineString", F.array(F.from_json(raw, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(raw, "array<array<array<double>>>"))
    long_ = F.filter(parts, lambda p: F.size(p) >= 2)
    text = F.transform(long_, lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda x: F.concat_ws(" ", x[0].cast("string"), x[1].cast("string"))), ", "), F.lit(")")))
    return F.when(F.size(long_) > 0, F.concat(F.lit("MULTILINESTRING("), F.array_join(text, ", "), F.lit(")")))


def national_network(docs: DataFrame) -> DataFrame:
    """Routes of the national network (NN above 0), with their signs, places and traffic; others are not on it."""
    p = lambda n: F.nullif(F.trim(_at(f"properties.{n}")), F.lit(""))
    num = lambda n: p(n).try_cast("double").try_cast("int")
    fips = num("STFIPS")
    ref = F.nullif(F.concat_ws(" ", p("SIGNT1"), p("SIGNN1")), F.lit(""))
    return elements(docs, "features").where(num("NN") > 0).select(
        num("ID").alias("route_id"), F.coalesce(p("LNAME"), ref).alias("route_name"), ref.alias("route_ref"), p("SIGNT1").alias("sign_type"), p("SIGNN1").alias("sign_num"), p("ROUTEID").alias("routeid_state"), num("NN").alias("nn"),
        fips.alias("state_fips"), F.try_element_at(lookup(FIPS), F.lpad(fips.cast("string"), 2, "0")).alias("state"), (fips * 1000 + num("CTFIPS")).alias("county_fips"), num("FCLASS").alias("fclass"), num("AADT").alias("aadt"), num("AADT_COM").alias("aadt_com"),
        num("THROUGH_LA").alias("through_lanes"), multiline_wkt(_at("geometry")).alias("geom_wkt"), F.concat(num("YEAR").cast("string"), F.lit("-01-01")).try_cast("date").alias("observed_at"), _at("properties").alias("props"))


def weekly_prices(docs: DataFrame) -> DataFrame:
    """region, product, week_of, price_usd_gal, observed_at; rows without a value carry no observation."""
    rows = docs.select(F.explode(F.coalesce(F.from_json(F.get_json_object("content", "$.response.data"), "array<string>"), F.array().cast("array<string>"))).alias("element"))
    area = F.trim(F.coalesce(_at("duoarea"), F.lit("")))
    week = _at("period").try_cast("date")
    out = rows.select(F.coalesce(F.try_element_at(lookup(AREAS), area), area).alias("region"), F.lit("diesel").alias("product"), week.alias("week_of"), _at("value").try_cast("double").alias("price_usd_gal"), week.alias("observed_at"), F.col("element").alias("props"))
    return out.where("price_usd_gal is not null")


def parking(docs: DataFrame, observed_at: str) -> DataFrame:
    """Parking sites; capacity stays null where unknown."""
    lon, lat = _lon_lat("latitude", "longitude")
    name = F.nullif(F.trim(_at("properties.nhs_rest_stop")), F.lit(""))
    kind = F.when(F.lower(name).rlike("rest area|welcome|scale|weigh"), "public_rest_area").otherwise("truck_stop")
    return elements(docs, "features").select(
        F.coalesce(_at("properties.OBJECTID"), _at("id")).alias("site_id"), kind.alias("kind"), name.alias("name"), F.nullif(F.upper(F.trim(_at("properties.state"))), F.lit("")).alias("state"), lat.alias("lat"), lon.alias("lon"),
        _at("properties.number_of_spots").try_cast("int").alias("truck_spaces"), F.lit(observed_at).cast("date").alias("observed_at"), _at("properties").alias("props"))


def tunnels(docs: DataFrame) -> DataFrame:
    """Tunnels: clearance in inches, hazmat tri-state, restriction codes; no id without both of its parts."""
    p = lambda n: _at(f"properties.{n}")
    lon, lat = _lon_lat("portal_latitude_i13", "portal_longitude_i14")
    fips, number = F.trim(F.coalesce(p("state_code_i3"), F.lit(""))), F.trim(F.coalesce(p("tunnel_number_i1"), F.lit("")))
    feet = F.coalesce(p("min_vert_clearance_over_tunnel_"), p("min_vert_clearance_over_tunnel_roadway_g2")).try_cast("double")
    length = p("tunnel_length_g1").try_cast("double")
    flags = codes(*[(coded_flag(p(col)) == want, f"{item}={int(want)}") for item, col in RESTRICTIONS for want in (True, False)])
    return elements(docs, "features").select(
        F.when((fips != "") & (number != ""), F.concat(fips, number)).alias("tunnel_id"), F.nullif(F.trim(p("tunnel_name_i2")), F.lit("")).alias("name"), F.try_element_at(lookup(FIPS), fips).alias("state"), lat.alias("lat"), lon.alias("lon"),
        F.when(length > 0, length).alias("length_ft"), F.when(feet > 0, F.round(feet * 12.0, 1)).alias("min_vert_clearance_in"), coded_flag(p("hazardous_material_restriction_")).alias("hazmat_restricted"), flags.alias("hazmat_codes"),
        F.concat(p("year").try_cast("int").cast("string"), F.lit("-01-01")).try_cast("date").alias("observed_at"), _at("properties").alias("props"))


def weather_alerts(docs: DataFrame) -> DataFrame:
    """Alerts; a null geometry names zones only."""
    return elements(docs, "features").select(
        F.coalesce(_at("properties.id"), _at("id")).alias("event_id"), F.lit("weather_alert").alias("kind"), geojson_wkt(_at("geometry")).alias("geom_wkt"),
        F.coalesce(_at("properties.sent"), _at("properties.effective")).try_cast("timestamp").alias("observed_at"), _at("properties").alias("props"))


def work_zones(docs: DataFrame) -> DataFrame:
    """Work zones of any version: old and new spellings are read; raises if no feature of a feed can be identified."""
    e = elements(docs, "features")
    of_doc = lambda path: F.get_json_object("document", f"$.{path}")
    feed = F.coalesce(*[F.nullif(of_doc(p), F.lit("")) for p in ("feed_info.publisher", "road_event_feed_info.publisher", "feed_info.data_sources[0].data_source_id", "road_event_feed_info.data_sources[0].data_source_id")])
    event = F.coalesce(_at("id"), _at("properties.road_event_id"), _at("properties.core_details.road_event_id"))
    either = lambda n: _first(f"properties.core_details.{n}", f"properties.{n}")

    def verified(end: str) -> Column:
        old = _at(f"properties.{end}_date_accuracy")
        return F.coalesce(_at(f"properties.is_{end}_date_verified").try_cast("boolean"), old == "verified")

    names = F.coalesce(F.from_json(F.coalesce(_at("properties.core_details.road_names"), _at("properties.road_names")), "array<string>"), F.when(either("road_name").isNotNull(), F.array(either("road_name"))))
    rows = e.withColumn("event", event)
    lost = rows.groupBy("path").agg(F.count("event").alias("n")).where("n = 0").select("path").take(1)
    if lost:
        raise NotAFeed(f"{lost[0]['path']}: no feature has an event id")
    return rows.where("event is not null").select(
        F.concat(F.coalesce(feed, _at("properties.core_details.data_source_id"), F.lit("wzdx")), F.lit("/"), F.col("event")).alias("event_id"), F.lit("work_zone").alias("kind"), geojson_wkt(_at("geometry")).alias("geom_wkt"),
        F.coalesce(either("update_date"), either("creation_date")).try_cast("timestamp").alias("observed_at"), either("event_type").alias("event_type"), either("direction").alias("direction"), names.alias("road_names"),
        _first("properties.vehicle_impact", "properties.core_details.vehicle_impact").alias("vehicle_impact"), verified("start").alias("is_start_date_verified"), verified("end").alias("is_end_date_verified"), _at("properties").alias("props"))


def chain_controls(docs: DataFrame) -> DataFrame:
    """Controls in service; an R-0 is a fact, a missing status unknown; wall time of the coast becomes an instant."""
    e = elements(docs, "data").withColumn("cc", _at("cc"))
    p = lambda n: _at(n, "cc")
    if not e.isEmpty() and e.where(p("index").isNotNull()).isEmpty():
        raise NotAFeed("no element is a chain control")
    status = F.nullif(p("statusData.status"), F.lit(""))
    wall = lambda d, t: F.to_utc_timestamp(F.concat_ws(" ", p(d), p(t)).try_cast("timestamp"), "America/Los_Angeles")
    at = F.coalesce(wall("statusData.statusTimestamp.statusDate", "statusData.statusTimestamp.statusTime"), wall("recordTimestamp.recordDate", "recordTimestamp.recordTime"))
    lon, lat = p("location.longitude").try_cast("double"), p("location.latitude").try_cast("double")
    return e.where(F.coalesce(p("index"), F.lit("")) != "").where(F.lower(F.coalesce(p("inService"), F.lit(""))) == "true").select(
        F.concat(F.lit("cwwp2-cc/"), p("index")).alias("event_id"), F.lit("chain_control").alias("kind"), F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))).alias("geom_wkt"),
        at.alias("observed_at"), status.alias("status"), (~F.upper(status).startswith("R-0")).alias("active"), p("location.route").alias("route"), p("location.county").alias("county"), F.col("cc").alias("props"))


def chain_sites(docs: DataFrame, spider: str, observed_at: str, floor: int = 0) -> DataFrame:
    """A chain's own locator; sites without a store number are left out; raises below the floor."""
    p = lambda n: F.get_json_object(_at("properties"), f"$['{n}']")
    lon, lat = _at("geometry.coordinates[0]").try_cast("double"), _at("geometry.coordinates[1]").try_cast("double")
    ok = (_at("geometry.type") == "Point") & lon.isNotNull() & lat.isNotNull() & (F.coalesce(p("ref"), F.lit("")) != "")
    state = F.upper(F.trim(p("addr:state")))
    rows = elements(docs, "features").where(ok).select(
        F.concat(F.lit(f"{spider}:"), p("ref")).alias("chain_site_id"), F.lit(spider).alias("spider"), F.coalesce(p("brand"), p("name")).alias("brand"), p("name").alias("name"), F.when(F.length(state) == 2, state).alias("state"), p("phone").alias("phone"),
        F.when(F.trim(p("opening_hours")).isin(ALWAYS_OPEN), F.lit(True)).alias("open_24h"), lon.alias("lon"), lat.alias("lat"), F.lit(observed_at).cast("date").alias("observed_at"))
    if floor and (n := rows.count()) < floor:
        raise NotAFeed(f"{spider}: {n} sites, {floor} are the least")
    return rows


def state_prices(docs: DataFrame) -> DataFrame:
    """state, price: from the cell labelled diesel of each row of an HTML table."""
    rows = docs.select(F.explode(F.slice(F.split("content", "<tr"), F.lit(2), F.greatest(F.size(F.split("content", "<tr")) - 1, F.lit(0)))).alias("r"))
    state = F.regexp_extract("r", r"[?&]state=([A-Z]{2})\b", 1)
    price = F.regexp_extract("r", r'<td[^>]*class="[^"]*\bdiesel\b[^"]*"[^>]*>\s*\$\s*([0-9]+\.[0-9]+)', 1)
    return rows.where((state != "") & (price != "") & state.isin(list(FIPS.values()))).select(state.alias("state"), F.round(price.try_cast("double"), 3).alias("price"))


def bridges(spark: SparkSession, zip_path: str, out_folder: str) -> DataFrame:
    """The national bridge file: the largest delimited member of a ZIP, quoted by apostrophes, several records a bridge.

    The member is streamed out of the archive into ``out_folder``, where all executors read it in parallel; no more
    than a buffer of it is held at a time.
    """
    jvm = spark.sparkContext._jvm
    path, io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def walk(take: str | None = None) -> list[tuple[str, int, int]]:
        """(name, bytes, year) of each member; the one to take is copied."""
        found, stream = [], jvm.java.util.zip.ZipInputStream(path(zip_path).getFileSystem(conf).open(path(zip_path)))
        try:
            while (entry := stream.getNextEntry()) is not None:
                name = entry.getName()
                if name == take:
                    target = path(f"{out_folder}/records.txt")
                    out = target.getFileSystem(conf).create(target, True)
                    try:
                        io.copyLarge(stream, out)
                    finally:
                        out.close()
                elif not take:
                    size = io.copyLarge(stream, jvm.org.apache.commons.io.output.NullOutputStream.INSTANCE)
                    found.append((name, size, entry.getTimeLocal().getYear()))
        finally:
            stream.close()
        return found

    names = walk()
    members = [m for m in names if m[0].lower().endswith((".txt", ".csv"))]
    if not members:
        raise NotAFeed("no delimited member")
    member = max(members, key=lambda m: m[1])
    walk(member[0])
    years = [m[0] for n in (member[0], *(x[0] for x in names)) if (m := re.search(r"(?:19|20)\d{2}", n))]
    df = spark.read.option("header", True).option("quote", "'").option("encoding", "ISO-8859-1").csv(out_folder)
    return merge_bridges(df.withColumn("observed_at", F.lit(f"{years[0] if years else member[2]}-01-01").cast("date")))


def merge_bridges(records: DataFrame) -> DataFrame:
    """One row per bridge: the record of the road on it is the base, else the first; the clearance is the least of all."""
    c = lambda n: F.nullif(F.trim(F.col(n)), F.lit(""))
    fips = F.substring(c("STATE_CODE_001"), 1, 2)
    clear = F.least(*[units.clearance_in(c(n)) for n in ("MIN_VERT_CLR_010", "VERT_CLR_OVER_MT_053", "VERT_CLR_UND_054B")])
    lon = units.packed_dms(c("LONG_017"), 3)
    r = records.withColumn("ordinal", F.monotonically_increasing_id()).select(
        "ordinal", F.concat(fips, F.coalesce(c("STRUCTURE_NUMBER_008"), F.lit(""))).alias("nbi_id"), F.coalesce(c("RECORD_TYPE_005A"), F.lit("?")).alias("record_type"), F.nullif(F.concat_ws(" / ", c("FACILITY_CARRIED_007"), c("FEATURES_DESC_006A")), F.lit("")).alias("name"),
        F.try_element_at(lookup(FIPS), fips).alias("state"), units.packed_dms(c("LAT_016"), 2).alias("lat"), (-lon).alias("lon"), clear.alias("clear"), c("OPERATING_RATING_064").alias("operating_rating"), c("INVENTORY_RATING_066").alias("inventory_rating"), c("OPEN_CLOSED_POSTED_041").alias("posting_status"), "observed_at")
    base = F.min(F.struct(F.when(F.col("record_type") == "1", 0).otherwise(1).alias("k"), "ordinal", F.struct("name", "state", "lat", "lon", "operating_rating", "inventory_rating", "posting_status", "observed_at").alias("b"))).alias("m")
    return r.groupBy("nbi_id").agg(base, F.min("clear").alias("min_vert_clearance_in"), F.sort_array(F.collect_set("record_type")).alias("record_types")).select("nbi_id", "m.b.*", "min_vert_clearance_in", "record_types")


def overpass_elements(docs: DataFrame, observed_at: Column | None) -> DataFrame:
    """(osm_id, lon, lat, tags) of nodes and of ways by their centre; a vintage is required."""
    if observed_at is None:
        raise NotAFeed("a vintage is required")
    e = elements(docs, "elements")
    nodes = F.from_json(_at("geometry"), "array<struct<ref:bigint,lon:double,lat:double>>")
    mean = way_centre(nodes)
    lon = F.coalesce(_at("lon").try_cast("double"), _at("center.lon").try_cast("double"), mean["lon"])
    lat = F.coalesce(_at("lat").try_cast("double"), _at("center.lat").try_cast("double"), mean["lat"])
    return e.select(F.concat_ws("/", _at("type"), _at("id")).alias("osm_id"), lon.alias("lon"), lat.alias("lat"), F.from_json(_at("tags"), "map<string,string>").alias("tags"), observed_at.alias("observed_at")).where("lon is not null and lat is not null")


def classify_registry(rows: DataFrame, states: dict[str, str]) -> DataFrame:
    """state, reason of a feed registry's rows: why one is left out, or null."""
    yes = lambda n: F.lower(F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))).isin("true", "t", "yes", "1")
    url, version = F.trim(F.coalesce("url", F.lit(""))), F.trim(F.coalesce("version", F.lit("")))
    state = F.try_element_at(lookup(states), F.lower(F.trim(F.coalesce("state", F.lit("")))))
    reason = (
        F.when(~yes("active"), "inactive").when(~url.startswith("http"), "no_url").when(yes("needAPIKey"), "needs_key").when(F.exists(F.split(F.lower(F.substring_index(url, "?", -1)), "&"), lambda p: F.substring_index(p, "=", 1).isin("apikey", "api_key", "token", "access_token") & (F.length(F.substring_index(p, "=", -1)) > 0) & p.contains("=")), "embedded_credential")
        .when((version != "") & (~F.substring_index(version, ".", 1).isin("3", "4") | version.cast("string").try_cast("double").isNull()), "other_schema").when(state.isNull(), "no_state")
    )
    return rows.select("*", state.alias("usps"), reason.alias("reason"))


def registry_ids(classified: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``classify_registry``'s rows with ``source_id`` where none is left out: a state's first feed, in the order of
    ``ordinal``, is wzdx_ and the state; its others add the feed's name, or else the organisation's."""
    kept = classified.where("reason is null")
    n = F.row_number().over(Window.partitionBy("usps").orderBy(ordinal))
    text = F.coalesce(F.nullif(F.trim("feedName"), F.lit("")), F.col("issuingOrganization"), F.lit(""))
    slug = F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), "_")
    base = F.concat(F.lit("wzdx_"), F.lower("usps"))
    ids = kept.withColumn("_n", n).withColumn("source_id", F.when(F.col("_n") == 1, base).otherwise(F.concat_ws("_", base, slug))).drop("_n")
    return ids.unionByName(classified.where("reason is not null").withColumn("source_id", F.lit(None).cast("string")))


def licences(pages: DataFrame, id_col: str, classes: list[str], class_col: str) -> DataFrame:
    """A registry's rows of the wanted classes; repeated ids get /2, /3, … in the order of the rest of the row."""
    others = [c for c in pages.columns if c != id_col]
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*others))
    return pages.where(F.col(class_col).isin(classes)).withColumn("_n", n).withColumn(id_col, F.when(F.col("_n") == 1, F.col(id_col)).otherwise(F.concat_ws("/", id_col, F.col("_n").cast("string")))).drop("_n")


def establishments(rows: DataFrame, naics: list[str]) -> DataFrame:
    """state with a column per industry: totals over all legal forms."""
    return rows.where((F.col("lfo") == "-") & F.col("naics").isin(naics)).withColumn("state", F.try_element_at(lookup(FIPS), F.col("fips"))).groupBy("state").pivot("naics", naics).agg(F.sum("estab"))


def first_label(labels: Column, taxonomy: dict[str, str], priority: list[str]) -> Column:
    """The slug of highest priority among a place's labels; null if none is mapped."""
    rank = {slug: i for i, slug in enumerate(priority)}
    table = F.create_map(*[F.lit(x) for k, v in taxonomy.items() for x in (k, v)])
    order = F.create_map(*[F.lit(x) for k, v in rank.items() for x in (k, v)])
    mapped = F.filter(F.transform(labels, lambda x: F.try_element_at(table, x)), lambda s: s.isNotNull())
    return F.array_min(F.transform(mapped, lambda s: F.struct(F.try_element_at(order, s).alias("p"), s.alias("slug"))))["slug"]


def places(spark: SparkSession, path: str, categories: list[str], boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Nested place records of the wanted categories in the boxes; both filters and the columns reach the scan."""
    d = spark.read.parquet(path)
    inside = F.lit(False)
    for x0, y0, x1, y1 in boxes:
        inside = inside | ((F.col("bbox.xmin") >= x0) & (F.col("bbox.xmax") <= x1) & (F.col("bbox.ymin") >= y0) & (F.col("bbox.ymax") <= y1))
    return d.where(F.col("categories.primary").isin(categories) & inside).select(
        "id", F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"), "confidence", F.try_element_at("addresses", F.lit(1)).alias("address"), F.col("bbox.xmin").alias("lon"), F.col("bbox.ymin").alias("lat"))
