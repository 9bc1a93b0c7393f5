"""Sinks: node databases, MaMuT, Amira and Tulip files, translations, points. A writer makes one line a row and
leaves the writing to Spark; files that need a frame or a whole document in order are encoded as (name, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the node database, and those that the expanded one adds.
DATABASE = ("id", "mother_id", "x", "y", "z", "r", "theta", "phi", "t", "label", "D-x", "D-y", "D-z", "D-r", "D-theta", "D-phi")
EXPANDED = ("x_M", "y_M", "z_M", "r_M", "theta_m", "phi_m", "d_m_x", "d_m_y", "d_m_z", "d_m_r", "d_m_theta", "d_m_phi", "d_m_L2", "alpha", "M_alpha", "d_m_alpha", "D_alpha")


def _polar(v: list[Column]) -> dict[str, Column]:
    """r, theta, phi, alpha of a vector; null where it is null."""
    x, y, z = v
    r = F.sqrt(x * x + y * y + z * z)
    phi = F.when(r > 0, F.acos(z / r)).when(r == 0, 0.0)
    return {"r": r, "theta": F.atan2(y, x), "phi": phi, "alpha": F.pmod(F.pi() / 2 + F.atan2(x, z), 2 * F.pi())}


def database_expanded(nodes: DataFrame, edges: DataFrame, centres: DataFrame | None = None, divisions: DataFrame | None = None) -> DataFrame:
    """DATABASE and EXPANDED columns, one row a node; what isn't known is -1.

    nodes: id, t, x, y, z, label. r to alpha are those of the way from a node to its frame's centre (centres: t, x, y, z).
    D-x to D-z: the division that belongs to a node (divisions: id, x, y, z), D-r to D_alpha its way to the centre. _M and
    _m: the mother's; d_m: the node's less the mother's, d_m_L2 their distance."""
    absent = lambda df, key: df.select(key, *[F.lit(None).cast("double").alias(c) for c in "xyz"]).limit(0)
    centres = absent(nodes, "t") if centres is None else centres
    divisions = absent(nodes, "id") if divisions is None else divisions
    full = nodes.select("id", "t", "x", "y", "z", "label").join(centres.select("t", *[F.col(c).alias(f"c{c}") for c in "xyz"]), "t", "left")
    full = full.join(divisions.select("id", *[F.col(c).alias(f"D-{c}") for c in "xyz"]), "id", "left")
    full = full.select("*", *[c.alias(k) for k, c in _polar([F.col(f"c{c}") - F.col(c) for c in "xyz"]).items()])
    full = full.select("*", *[c.alias("D_alpha" if k == "alpha" else f"D-{k}") for k, c in _polar([F.col(f"c{c}") - F.col(f"`D-{c}`") for c in "xyz"]).items()])
    names = {"x": "x_M", "y": "y_M", "z": "z_M", "r": "r_M", "theta": "theta_m", "phi": "phi_m", "alpha": "M_alpha"}
    mothers = full.select(F.col("id").alias("mother_id"), *[F.col(c).alias(m) for c, m in names.items()])
    full = full.join(edges.select(F.col("dst").alias("id"), F.col("src").alias("mother_id")), "id", "left").join(mothers, "mother_id", "left")
    full = full.select("*", *[(F.col(c) - F.col(m)).alias(f"d_m_{c}") for c, m in names.items()])
    full = full.withColumn("d_m_L2", F.sqrt(sum(F.pow(f"d_m_{c}", F.lit(2)) for c in "xyz")))
    return full.select(*[F.col(c) if c in ("id", "x", "y", "z", "t") else F.coalesce(F.col(f"`{c}`"), F.lit(-1)).alias(c) for c in DATABASE + EXPANDED])


def database(nodes: DataFrame, edges: DataFrame, centres: DataFrame | None = None, divisions: DataFrame | None = None) -> DataFrame:
    """The 16 DATABASE columns of database_expanded()."""
    return database_expanded(nodes, edges, centres, divisions).select(*[F.col(f"`{c}`") for c in DATABASE])


def to_csv(df: DataFrame, folder: str, digits: int = 5) -> None:
    """CSV with a header; doubles with fixed digits."""
    cols = [F.format_string(f"%.{digits}f", F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(folder)


def amira(nodes: DataFrame, edges: DataFrame, length: int = 5) -> DataFrame:
    """name, content: a file a frame with each node's way through `length` ancestors, clamped at the root, oldest last; its
    label; and the distance to its mother (0 at roots). nodes: id, t, x, y, z, label."""
    up = edges.select(F.col("dst").alias("at"), F.col("src").alias("up"))
    at = nodes.select(F.col("id").alias("at"), F.array("x", "y", "z").alias("p"))
    line = nodes.select("id", "t", "label", F.array(F.array("x", "y", "z")).alias("l"), F.col("id").alias("at"))
    for _ in range(length):
        line = line.join(up, "at", "left").withColumn("at", F.coalesce("up", "at")).drop("up").join(at, "at").withColumn("l", F.concat("l", F.array("p"))).drop("p")
    num = lambda x: F.format_string("%.5f", x)
    point = lambda p: F.concat_ws(" ", num(p[0]), num(p[1]), num(p[2]))
    speed = F.sqrt(sum(F.pow(F.col("l")[0][k] - F.col("l")[1][k], 2) for k in range(3))) if length else F.lit(0.0)
    one = line.select("t", "id", F.concat_ws("\n", F.transform("l", point)).alias("pts"), F.col("label").cast("string").alias("label"), num(speed).alias("speed"))
    rows = one.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("id", "pts", "label", "speed"))).alias("r"), F.count(F.lit(1)).alias("n"))
    n, m = F.col("n").cast("string"), (F.col("n") * (length + 1)).cast("string")
    col = lambda c: F.concat_ws("\n", F.transform("r", lambda s: s[c]))
    # The layout of Amira line sets.
    content = F.concat_ws(
        "\n", F.lit("# AmiraMesh 3D ASCII 2.0\n"), F.concat(F.lit("define VERTEX "), n), F.concat(F.lit("define EDGE "), n), F.concat(F.lit("define POINT "), m),
        F.lit('\nParameters { ContentType "HxSpatialGraph" }\n\nPOINT { float[3] EdgePointCoordinates } @1\nEDGE { int Label } @2\nEDGE { float Velocity } @3\n\n@1'), col("pts"), F.lit("\n@2"), col("label"), F.lit("\n@3"), col("speed"))
    return rows.select(F.format_string("frame-%05d.am", F.col("t").cast("long")).alias("name"), F.encode(F.concat(content, F.lit("\n")), "UTF-8").alias("content"))


def tulip_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section, k, line: a Tulip graph in order of (section, k): nodes, edges, times, layout, lengths of edges."""
    numbered = edges.select("src", "dst", F.xxhash64("src", "dst").alias("e"))
    at = lambda p: nodes.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    long = numbered.join(at("src"), "src").join(at("dst"), "dst").withColumn("d", F.sqrt(sum(F.pow(F.col(f"src{c}") - F.col(f"dst{c}"), 2) for c in "xyz")))
    s = lambda df, n, k, f, *c: df.select(F.lit(n).alias("section"), F.col(k).alias("k"), F.format_string(f, *c).alias("line"))
    one = lambda n, text: nodes.sparkSession.createDataFrame([(n, -(1 << 62), text)], "section int, k long, line string")
    end = lambda n: one(n, ")")
    parts = [
        one(0, '(tlp "2.0"'), s(nodes, 1, "id", "(node %d)", F.col("id")), s(numbered, 2, "e", "(edge %d %d %d)", F.col("e"), F.col("src"), F.col("dst")),
        one(3, '(property 0 int "time" (default "0" "0")'), s(nodes, 4, "id", '(node %d "%d")', F.col("id"), F.col("t")), end(5),
        one(6, '(property 0 layout "viewLayout" (default "(0,0,0)" "()")'), s(nodes, 7, "id", '(node %d "(%f,%f,%f)")', F.col("id"), *[F.col(c) for c in "xyz"]), end(8),
        one(9, '(property 0 double "distance" (default "0" "0")'), s(long, 10, "e", '(edge %d "%f")', F.col("e"), F.col("d")), end(11), end(12)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mamut_lines(nodes: DataFrame, edges: DataFrame, size: float = 1.0, gap: float = 1.0, image: str = "", folder: str = "") -> DataFrame:
    """section, a, b, line: a MaMuT file in order of (section, a, b). Spots are nodes (id, t, x, y, z, label) by frame, in
    units of `size`; tracks are the chains below the nodes without a mother among them, each edge with its length and its
    speed (length / gap). Edges with an end outside `nodes` are left out."""
    from chronovox.operators.lineage import to_root

    spark = nodes.sparkSession
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    at = lambda p: nodes.select(F.col("id").alias(p), F.col("t").alias(f"{p}t"), F.col("label").alias(f"{p}l"), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    long = inside.join(at("src"), "src").join(at("dst"), "dst").withColumn("d", F.sqrt(sum(F.pow(F.col(f"src{c}") - F.col(f"dst{c}"), 2) for c in "xyz")) * size)
    tops = to_root(inside)
    edge = long.join(tops.select(F.col("id").alias("dst"), "root"), "dst")
    track = tops.join(nodes.select("id", "t"), "id").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    frames = nodes.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    s = lambda df, n, a, b, f, *c: df.select(F.lit(n).alias("section"), F.col(a).cast("long").alias("a"), (F.col(b) if isinstance(b, str) else b).cast("long").alias("b"), F.format_string(f, *c).alias("line"))
    one = lambda n, text: spark.createDataFrame([(n, 0, 0, text)], "section int, a long, b long, line string")
    first, last = F.lit(-(1 << 62)), F.lit((1 << 62))
    place = [F.col(c) * size for c in "xyz"]
    # Element and attribute names of the format.
    parts = [
        one(0, '<?xml version="1.0" encoding="UTF-8"?>\n<TrackMate version="2.7.3">\n<Model spatialunits="pixels" timeunits="frames">'),
        s(nodes.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("z")), 1, "z", "z", '<AllSpots nspots="%d">', F.col("n")),
        s(frames, 2, "t", first, '<SpotsInFrame frame="%d">', F.col("t")),
        s(nodes, 2, "t", "id", '<Spot ID="%d" name="%d" frame="%d" POSITION_X="%.5f" POSITION_Y="%.5f" POSITION_Z="%.5f" TISSUE_TYPE="%d" VISIBILITY="1" RADIUS="10.0"></Spot>',
          F.col("id"), F.col("id"), F.col("t"), *place, F.col("label")),
        s(frames, 2, "t", last, "%s", F.lit("</SpotsInFrame>")), one(3, "</AllSpots>\n<AllTracks>"),
        s(track, 4, "root", first, '<Track name="Track_%d" TRACK_ID="%d" TRACK_DURATION="%d" TRACK_START="%d" TRACK_STOP="%d" NUMBER_SPOTS="%d">',
          F.col("root"), F.col("root"), F.col("n"), F.col("t0"), F.col("t1"), F.col("n")),
        s(edge, 4, "root", "dst", '<Edge SPOT_SOURCE_ID="%d" SPOT_TARGET_ID="%d" DISPLACEMENT="%.5f" VELOCITY="%.5f" EDGE_TIME="%d" TISSUE_TYPE="%d"></Edge>',
          F.col("src"), F.col("dst"), F.col("d"), F.col("d") / gap, F.col("srct"), F.col("srcl")),
        s(track, 4, "root", last, "%s", F.lit("</Track>")), one(5, "</AllTracks>\n<FilteredTracks>"),
        s(track, 6, "root", "root", '<TrackID TRACK_ID="%d" />', F.col("root")),
        one(7, f'</FilteredTracks>\n</Model>\n<Settings><ImageData filename="{image}" folder="{folder}" /></Settings>\n</TrackMate>')]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_text(lines: DataFrame, order: list[str], folder: str) -> None:
    """Lines in order: Spark sorts them by range, and its part files, read by name, make the document."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(folder)


def to_mamut(nodes: DataFrame, edges: DataFrame, folder: str, most: int = 1 << 15) -> None:
    """A MaMuT file as a folder of documents of about `most` spots each, none of them whole in one task. Readers of elements
    lose what follows a line that isn't well-formed, so every document has the head, the foot and the frames' elements (of
    the whole: nspots counts all). Spots are dealt by their ids, tracks by their roots; a track has all its edges in one."""
    n = max(1, -(-nodes.count() // most))
    spot = (F.col("section") == 2) & F.coalesce(F.abs("b") < (1 << 62), F.lit(True))
    own = F.when(spot, F.xxhash64("b")).when(F.col("section").isin(4, 6), F.xxhash64("a"))
    at = F.when(own.isNotNull(), F.array(F.pmod(own, F.lit(n)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = mamut_lines(nodes, edges).withColumn("document", F.explode(at)).repartition("document")
    dealt.sortWithinPartitions("document", "section", "a", "b").select("document", "line").write.mode("overwrite").partitionBy("document").text(folder)


def translations(steps: DataFrame, folder: str) -> None:
    """t, dx, dy, dz as CSV."""
    to_csv(steps.select("t", "dx", "dy", "dz"), folder)


def point_lines(points: DataFrame) -> DataFrame:
    """t, i, line: `x y z` lines of points (t, i, x, y, z)."""
    return points.select("t", "i", F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("line"))


def correspondence_lines(couples: DataFrame) -> DataFrame:
    """g, line: `l0 l1 - r0 r1` lines of couples (g, l, r), a line for each g, labels in order. Every l of a line belongs to
    every r when it is read again, so couples of one g must be all pairs of its labels; others raise an error. A line holds
    one number's labels; couples with a null are left out."""
    rows = couples.where("g IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL").select(*[F.col(c).cast("long").alias(c) for c in ("g", "l", "r")]).distinct()
    sides = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("l")).alias("ls"), F.array_sort(F.collect_set("r")).alias("rs"))
    whole = F.when(F.col("n") == F.size("ls") * F.size("rs"), F.concat_ws(" - ", F.array_join("ls", " "), F.array_join("rs", " ")))
    return sides.select("g", F.coalesce(whole, F.raise_error(F.lit("a number's couples are not all pairs of its labels"))).alias("line"))


def to_correspondences(couples: DataFrame, folder: str) -> None:
    """A folder of text files that texts.correspondences() reads."""
    correspondence_lines(couples).select("line").write.mode("overwrite").text(folder)
