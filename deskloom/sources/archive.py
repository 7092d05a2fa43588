"""From a chat server's archive, which stores two copies of a message, to one row for each message to or from support.

archive: id, username (owner of the copy), peer, bare_peer, txt, created_at, timestamp (µs), xml (bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.signals import strip

OPERATOR_PREFIX, PAIR_MICROS = "help", 1_000_000  # fixed values


def local_part(jid: Column) -> Column:
    """The name before the host. Names of accounts don't differ by case, so they are kept in lower case from here on."""
    return F.lower(F.substring_index(jid, "@", 1))


def stanza_id(xml: Column) -> Column:
    """The text after the first bytes 0B 06 and a length; null if the length is 0 or goes past the end."""
    rest = F.regexp_extract(F.decode(xml, "ISO-8859-1"), r"(?s)\x0B\x06(.*)", 1)  # one character for each byte; empty where the mark isn't
    size = F.ascii(rest)
    good = (size > 0) & (F.length(rest) > size)
    return F.when(good, F.decode(F.encode(rest.substr(F.lit(2), size), "ISO-8859-1"), "UTF-8"))


def to_business_time(t: Column, source_zone: str | None, business_zone: str | None) -> Column:
    """A wall-clock time of the source's zone as the wall-clock time of the zone that working hours are in; both zones or neither."""
    if (source_zone is None) != (business_zone is None):
        raise ValueError("source_zone and business_zone go together")
    return t if source_zone is None else F.convert_timezone(F.lit(source_zone), F.lit(business_zone), t)


def iso_time(t: Column) -> Column:
    """The shortest ISO form of a time: no seconds if they are 0, a fraction of three or six digits only if there is one."""
    micros = F.unix_micros(t.cast("timestamp")) % 1_000_000
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(t, ".SSS")).otherwise(F.date_format(t, ".SSSSSS"))
    seconds = F.when((F.second(t) == 0) & (micros == 0), "").otherwise(F.concat(F.date_format(t, ":ss"), fraction))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm"), seconds)


def dedup_hash(client: Column, identity: Column, txt: Column) -> Column:
    """What tells a message: its client, its stanza or else its time, and its text; not its author."""
    return F.unhex(F.sha1(F.concat(client, F.lit("\0"), identity, F.lit("\0"), txt)))


def erlang_groups(term: Column) -> Column:
    """Names in the list after ``displayed_groups``, without desks' own groups and the group of all."""
    inside = F.regexp_extract(term, r"(?s)displayed_groups[^\[]*\[([^\]]*)\]", 1)
    names = F.regexp_extract_all(inside, F.lit('<<"([^"]*)">>'), 1)
    return F.filter(names, lambda g: ~F.lower(g).startswith("help") & (F.lower(g) != "all"))


def id_ranges(counts: list[tuple[int, int]], width: int, tasks: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of ids with about equal numbers of rows, from rows by bucket of ``width`` ids."""
    share, held, out = sum(n for _, n in counts) / max(1, tasks), 0, []
    for bucket, n in sorted(counts):
        if not out or (held >= share and len(out) < tasks):
            out.append([bucket * width, 0])
            held = 0
        out[-1][1], held = (bucket + 1) * width, held + n
    return [tuple(r) for r in out]


def archive_rows(spark: SparkSession, url: str, table: str = "archive", above: int = -1, to: int | None = None, tasks: int = 8, **options: str) -> DataFrame:
    """The archive's rows with texts over JDBC, above a watermark and up to ``to``, in ``tasks`` ranges of ids with about as many rows each.

    Ids have gaps, so ranges come from the numbers of rows in 64 buckets of ids for each task, which the database counts.
    """
    source = lambda query: spark.read.format("jdbc").options(url=url, **options).option("query", query).load()
    some = f"FROM {table} WHERE id > {above} AND txt IS NOT NULL" + ("" if to is None else f" AND id <= {to}")
    low, high = source(f"SELECT MIN(id) AS low, MAX(id) AS high {some}").first()
    columns = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if low is None:
        return columns.load().where(F.lit(False))
    width = (int(high) - int(low)) // (64 * tasks) + 1
    counts = source(f"SELECT b, COUNT(*) AS n FROM (SELECT FLOOR(id / {width}) AS b {some}) AS x GROUP BY b").collect()
    ranges = id_ranges([(int(b), int(n)) for b, n in counts], width, tasks)
    inside = [f"id >= {max(s, above + 1)} AND id < {e} AND txt IS NOT NULL" + ("" if to is None else f" AND id <= {to}") for s, e in ranges]
    return spark.read.jdbc(url, table, predicates=inside, properties=dict(options))


def prepared(archive: DataFrame, source_zone: str | None = None, business_zone: str | None = None) -> DataFrame:
    """The archive's rows that say something, with their stanza and business time instead of the raw one."""
    rows = archive.where("txt IS NOT NULL").withColumn("txt", strip(F.col("txt"))).where("txt <> ''").withColumn("stanza", stanza_id(F.col("xml")))
    at = to_business_time(F.col("created_at"), source_zone, business_zone)
    return rows.select("id", "username", "peer", "bare_peer", "txt", at.alias("created_at"), "timestamp", "stanza")


def paired(rows: DataFrame) -> DataFrame:
    """Prepared rows with nth, paired and last.

    Copies of one stanza are taken in id order: equal texts less than a second apart are a pair. In a run of rows that each match the
    one before, pairs are the 1st and 2nd, the 3rd and 4th, ...; ``nth`` is the place in the run, ``paired`` says whether another follows, ``last`` whether
    the row is its stanza's last.
    """
    rows = rows.withColumn("single", F.when(F.col("stanza").isNull(), F.col("id")))  # a row without a stanza is alone
    w = Window.partitionBy("stanza", "single").orderBy("id")
    match = (F.lag("txt").over(w) == F.col("txt")) & (F.col("timestamp") - F.lag("timestamp").over(w) < PAIR_MICROS)
    runs = rows.withColumns({"match": F.coalesce(match, F.lit(False)), "last": F.lead("id").over(w).isNull(), "place": F.row_number().over(w)})
    begins = F.max(F.when(~F.col("match"), F.col("place"))).over(w)  # of the run at hand; one order serves all windows
    runs = runs.withColumns({"nth": F.col("place") - begins + 1, "paired": F.coalesce(F.lead("match").over(w), F.lit(False))})
    return runs.drop("match", "place", "single")


def authored(kept: DataFrame, *more: str) -> DataFrame:
    """A message for each row, with ``alone``: its author if the row had no partner. Only messages between a desk and a client.

    A pair was written by its first copy's owner, a row left over by its owner too, unless its peer has a resource.
    """
    owner, peer = local_part(F.col("username")), local_part(F.col("bare_peer"))
    alone = F.when(F.col("peer").contains("/"), local_part(F.col("peer"))).otherwise(owner)
    kept = kept.withColumn("alone", alone).withColumn("author", F.when(F.col("paired"), owner).otherwise(F.col("alone")))
    kept = kept.withColumn("recipient", F.when(F.col("author") == owner, peer).otherwise(owner))
    from_desk, to_desk = (F.col(c).startswith(OPERATOR_PREFIX) for c in ("author", "recipient"))
    kept = kept.where(from_desk != to_desk).withColumn("client", F.when(from_desk, F.col("recipient")).otherwise(F.col("author")))
    digest = dedup_hash(F.col("client"), F.coalesce("stanza", iso_time(F.col("created_at"))), F.col("txt"))
    direction = F.when(from_desk, "out").otherwise("in").alias("direction")
    return kept.select(F.col("id").alias("source_id"), "client", "author", "recipient", direction, "txt", "created_at", digest.alias("dedup_hash"), "alone", *more)


def first_of_hash(messages: DataFrame) -> DataFrame:
    dealt = messages.repartition("dedup_hash")  # few rows share a hash, so adding up before the shuffle would sort all rows once more for nothing
    first = dealt.groupBy("dedup_hash").agg(F.min(F.struct(*messages.columns)).alias("first"))
    return first.select("first.*")


def normalized(archive: DataFrame, source_zone: str | None = None, business_zone: str | None = None) -> DataFrame:
    """source_id, client, author, recipient, direction, txt, created_at, dedup_hash: each message once, the first of its hash."""
    return first_of_hash(authored(paired(prepared(archive, source_zone, business_zone)).where("nth % 2 = 1")).drop("alone"))


def memberships(users: DataFrame, last: DataFrame, source_zone: str | None = None, business_zone: str | None = None) -> DataFrame:
    """client, grp, last_seen_at from (jid, grp) and (username, seconds since 1970); times are those of the zones, else UTC."""
    utc = F.convert_timezone(F.lit("UTC"), F.lit(source_zone or "UTC"), F.timestamp_seconds("seconds").cast("timestamp_ntz"))
    seen = last.select(F.lower("username").alias("client"), to_business_time(utc, source_zone, business_zone).alias("last_seen_at"))
    return users.select(local_part(F.col("jid")).alias("client"), "grp").distinct().join(seen, "client", "left")


def desk_groups(users: DataFrame, groups: DataFrame) -> DataFrame:
    """account, grp: the groups that each desk serves, named in the options of the desk's own group."""
    desks = users.where(
        F.lower("grp").startswith("help") & F.lower("jid").startswith("help")
    ).select(local_part(F.col("jid")).alias("account"), F.lower("grp").alias("k"))
    served = groups.select(F.lower("name").alias("k"), F.explode(erlang_groups(F.col("opts"))).alias("grp"))
    return desks.join(served, "k").select("account", "grp").distinct()


def archived(messages: DataFrame) -> DataFrame:
    """An archive whose normal form is ``messages``: two copies of each, some single, with service rows and private talk between."""
    m = messages.withColumn("micros", F.unix_micros(F.col("created_at").cast("timestamp")))
    stanza = F.concat(F.lit("s"), F.lpad(F.col("source_id").cast("string"), 9, "0"))
    xml = F.concat(
        F.unhex(F.lit("010B050B06")), F.unhex(F.lpad(F.hex(F.length(stanza)), 2, "0")), F.encode(stanza, "UTF-8"),
        F.unhex(F.lit("FF0B06"))
    )
    host = lambda c: F.concat(c, F.lit("@desk"))

    def copy(owner: str, other: str, shift: int, resource: str, place: int, txt: Column = F.col("txt")) -> DataFrame:
        return m.select(
            (F.col("source_id") * 4 + place).alias("id"), F.col(owner).alias("username"),
            F.concat(host(F.col(other)), F.lit(resource)).alias("peer"), host(F.col(other)).alias("bare_peer"),
            txt.alias("txt"), "created_at", (F.col("micros") + shift).alias("timestamp"), xml.alias("xml"), "source_id"
        )

    sent = copy("author", "recipient", 0, "", 0).where("source_id % 17 <> 0")
    received = copy("recipient", "author", 1500, "/phone", 1)
    service = copy("author", "recipient", 3000, "", 2, F.lit("  ")).where("source_id % 13 = 0")
    private = copy(
        "author", "recipient", 5000, "", 3, F.lit("между собой")
    ).where("source_id % 19 = 0").withColumn("username", F.lit("u1")).withColumn("bare_peer", F.lit("u2@desk")).withColumn("peer", F.lit("u2@desk"))
    return sent.unionByName(received).unionByName(service).unionByName(private).drop("source_id")
