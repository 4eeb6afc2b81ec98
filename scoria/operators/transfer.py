"""Plans and checks of transfers: paged requests, batches, uploads, headers, limits and reuse. What is sent or fetched is not here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles of credentials, and the greatest spool and least free disk in bytes.
ROLES = ("client", "warm")
SPOOL_BYTES, FREE_BYTES = 25 * 10**9, 50 * 10**9


def paged(ids: DataFrame, cell: list[str], id_: str, size: int, most: int) -> DataFrame:
    """(cell, page, ids, exceeded): the distinct ids of each cell in pages of a size, in order.

    A cell with more than `most` ids is answered incompletely by its source: its pages are marked, and none of them is to be
    used. A page is bounded by its size; cells are numbered by a window, whose rows are ids only.
    """
    one = ids.select(*cell, id_).filter(F.col(id_).isNotNull()).distinct()
    at = F.row_number().over(Window.partitionBy(*cell).orderBy(id_)) - 1
    total = F.count("*").over(Window.partitionBy(*cell))
    pages = one.select(*cell, F.col(id_), F.floor(at / size).alias("page"), (total > most).alias("exceeded"))
    return pages.groupBy(*cell, "page", "exceeded").agg(F.array_sort(F.collect_list(id_)).alias("ids"))


def short_pages(pages: DataFrame, objects: DataFrame, cell: list[str], id_: str) -> DataFrame:
    """Pages (cell, page, wanted, got) for which not every object came."""
    want = pages.select(*cell, "page", F.explode("ids").alias(id_))
    got = want.join(objects.select(id_).distinct().withColumn("_got", F.lit(1)), id_, "left")
    n = got.groupBy(*cell, "page").agg(F.count("*").alias("wanted"), F.count("_got").alias("got"))
    return n.filter("wanted <> got")


def metatiles(tiles: DataFrame, side: int = 16) -> DataFrame:
    """Tiles with the larger request (px, py) that they are cut from, and where they lie in it (dx, dy)."""
    at = lambda c: F.floor(F.col(c) / side)
    return tiles.select("*", at("x").alias("px"), at("y").alias("py"), (F.col("x") - at("x") * side).alias("dx"), (F.col("y") - at("y") * side).alias("dy"))


def accepts_gzip(header: Column) -> Column:
    """Whether an Accept-Encoding header takes gzip: its first gzip entry has no weight that is zero or no number."""
    parts = lambda e: F.transform(F.split(e, ";"), lambda p: F.trim(p))
    gzip = F.filter(F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), ","), parts), lambda p: p[0] == "gzip")
    weights = F.filter(F.get(gzip, 0), lambda p: p.startswith("q="))
    good = F.forall(weights, lambda w: F.coalesce(F.substring(w, 3, 100).try_cast("double") > 0, F.lit(False)))
    return (F.size(gzip) > 0) & F.coalesce(good, F.lit(False))


def put_action(size: Column, sha: Column, known_size: Column, known_sha: Column, done: Column) -> Column:
    """What a put does: changed (an object under a key never changes), skip (done), or upload."""
    return F.when(known_sha.isNotNull() & ((known_size != size) | (known_sha != sha)), "changed").when(F.coalesce(done, F.lit(False)), "skip").otherwise("upload")


def batches(rows: DataFrame, key: list[str], order: list[str], text: Column, size: int = 50) -> DataFrame:
    """(key, batch, n, text): each key's rows in batches, each row on a line of its own with a line break before it, so that a torn one harms no other."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    r = rows.select(*key, (at / size).cast("bigint").alias("batch"), at.alias("_at"), F.concat(F.lit("\n"), text).alias("_t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda x: x["_t"]), "")
    return r.groupBy(*key, "batch").agg(F.count("*").alias("n"), joined.alias("text"))


def batch_status(keys: Column, dataset: Column, current: Column, most: int = 8) -> Column:
    """Status of a request for a batch of tiles: 409 for another dataset, 400 unless it has one to eight distinct keys, else 200."""
    n = F.size(keys)
    return F.when(dataset != current, 409).when((n < 1) | (n > most) | (F.size(F.array_distinct(keys)) != n), 400).otherwise(200)


def reuse(build: Column, cached: Column, has_raw: Column) -> Column:
    """What a cell needs: nothing where its version is current, a rebuild from its raw answer, or a fetch."""
    return F.when(F.coalesce(cached == build, F.lit(False)), "cached").when(cached.isNotNull() & has_raw, "rebuild").otherwise("fetch")


def paused(free: Column, spool: Column) -> Column:
    """Why work stops, null if it does not: the disk's reserve, then the spool's ceiling."""
    return F.when(free < FREE_BYTES, "disk").when(spool > SPOOL_BYTES, "spool")


def valid_limits(limits: Column, roles: Column, digests: Column) -> Column:
    """Whether a configuration may be used: limits are whole numbers from 0, roles known, digests of 64 letters."""
    whole = F.forall(limits, lambda v: F.coalesce(v.rlike("^[0-9]+$"), F.lit(False)))
    return whole & F.forall(roles, lambda r: r.isin(*ROLES)) & F.forall(digests, lambda d: F.length(d) == 64)


def tile_action(done: Column, cached: Column, valid: Column) -> Column:
    """What publishing a tile does: skip it, reuse the bytes at hand, or render it."""
    return F.when(F.coalesce(done, F.lit(False)), "skip").when(F.coalesce(cached & valid, F.lit(False)), "reuse").otherwise("render")


def fingerprint(files: DataFrame, key: list[str], name: str, body: str) -> DataFrame:
    """(key, hash): SHA-256 over each key's names and bodies in order of the name. For lists of files, which are few."""
    each = F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("n"), F.col(body).cast("string").alias("b"))))
    return files.groupBy(*key).agg(F.sha2(F.array_join(F.transform(each, lambda f: F.concat(f["n"], f["b"])), ""), 256).alias("hash"))


def working_path(path: Column, root: str, scratch: str | None, there: Column) -> Column:
    """Where a file under the root is written: at its place under the scratch folder, unless it is there already or nothing is set."""
    if not scratch:
        return path
    inside = lambda folder: (path == folder) | path.startswith(folder.rstrip("/") + "/")
    moved = F.concat(F.lit(scratch.rstrip("/") + "/source-cache"), F.substring(path, len(root.rstrip("/")) + 1, 100_000))
    return F.when(there | ~inside(root) | inside(scratch), path).otherwise(moved)


def resume(size: Column, have: Column, body: Column, md5: Column) -> Column:
    """struct(offset, sound): where a download goes on, and whether what is complete has the expected checksum."""
    return F.struct(F.when(have < size, have).otherwise(size).alias("offset"), F.when(have >= size, F.md5(body) == md5).alias("sound"))


def render_order(requests: DataFrame, slots: int) -> DataFrame:
    """Requests (id, at, background) with the turn in which they get one of some slots: those of people first, then by time."""
    at = F.row_number().over(Window.partitionBy("gate").orderBy(F.col("background").cast("int"), "at", "id")) - 1
    return requests.withColumn("turn", F.floor(at / slots))


def may_warm(free: Column, floor: Column, active: Column, quiet_s: Column, least_quiet_s: float) -> Column:
    """Whether tiles may be warmed: with disk to spare, nobody at work, and quiet for a while."""
    return F.when(free < floor, False).when(active, False).otherwise(quiet_s >= least_quiet_s)
