"""Harvests over recorded responses: tiles that split where a page limit is hit, pages, retries, failed regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Pages that a search gives at most, tries of a request, seconds before the second try, and by how much waits grow.
PAGES, ATTEMPTS, WAIT_S, WAIT_GROWS = 3, 4, 5.0, 3.0
#: Responses after which a request is tried again (none recorded: the connection was lost); any other but 200 fails.
AGAIN = (403, 429, 504)


def tile_box(south: Column, west: Column, north: Column, east: Column, tile: Column) -> Column:
    """struct(south, west, north, east) of a tile of a box: each digit of its name is a quarter, 1 to the east, 2 to the north."""
    start = F.struct(*[F.col(c) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip((south, west, north, east), ("south", "west", "north", "east"))])

    def quarter(b: Column, d: Column) -> Column:
        q = d.cast("int")
        middle, centre = (b["south"] + b["north"]) / 2, (b["west"] + b["east"]) / 2
        up, right = q.bitwiseAND(F.lit(2)) > 0, q.bitwiseAND(F.lit(1)) > 0
        return F.struct(
            F.when(up, middle).otherwise(b["south"]).alias("south"), F.when(right, centre).otherwise(b["west"]).alias("west"),
            F.when(up, b["north"]).otherwise(middle).alias("north"), F.when(right, b["east"]).otherwise(centre).alias("east"),
        )

    return F.aggregate(F.filter(F.split(tile, ""), lambda d: d != ""), start, quarter)


def tile_at(south: Column, west: Column, north: Column, east: Column, lat: Column, lng: Column, depth: int) -> Column:
    """The name of the tile of ``depth`` digits that a place in a box lies in; edges belong to the north and east."""
    cells = 1 << depth
    cell = lambda x, lo, hi: F.least(F.greatest(F.floor((x - lo) / (hi - lo) * cells), F.lit(0)), F.lit(cells - 1))
    up, right = cell(lat, south, north), cell(lng, west, east)
    digit = lambda k: F.concat((2 * F.shiftright(up, depth - 1 - k).bitwiseAND(F.lit(1)) + F.shiftright(right, depth - 1 - k).bitwiseAND(F.lit(1))).cast("string"))
    return F.concat(F.lit(""), *[digit(k) for k in range(depth)])


def crawl(regions: DataFrame, recorded: DataFrame, *, pages: int = PAGES, attempts: int = ATTEMPTS, depth: int = 8, wait: float = WAIT_S) -> tuple[DataFrame, DataFrame]:
    """SRC9, SRC10: (places, regions) of a harvest of ``regions`` whose responses are ``recorded``.

    regions: region. recorded: region, tile, token (null for a first page), attempt (from 1), status, places (array of
    structs with id), next_token. Every region begins with the tile of no digits. A tile's pages follow one another by
    their tokens; where the last page allowed still has a token, the tile is split into its four quarters, down to
    ``depth`` digits. Throttled and lost requests are tried again, ``attempts`` times in all, after waits that grow; a
    request that fails for good makes its region one that failed.

    places: region, tile, page, place: of equal ids in a region the first by tile, page and place; places without an id
    all stay; failed regions have none. regions: region, failed, n_places (null where failed), n_requests, n_split,
    waited_s. Requests of a round are one join, so a round costs what its requests do, and rounds are as many as the
    longest chain of requests.
    """
    recorded = checkpointed(recorded.withColumnsRenamed({c: f"_{c}" for c in ("region", "tile", "token", "attempt")}))  # every round reads it
    none = F.lit(None).cast("string")
    frontier = checkpointed(regions.select("region").distinct().select("region", F.lit("").alias("tile"), F.lit(1).alias("page"), none.alias("token"), F.lit(1).alias("attempt")))
    rounds: list[DataFrame] = []
    while frontier.limit(1).count():
        same = (F.col("region") == F.col("_region")) & (F.col("tile") == F.col("_tile")) & F.col("token").eqNullSafe(F.col("_token")) & (F.col("attempt") == F.col("_attempt"))
        got = frontier.join(recorded.join(frontier, same, "left_semi"), same, "left")  # of the responses only those asked for are shuffled
        again = F.coalesce(F.col("status").isin(*AGAIN), F.lit(True))
        outcome = F.when(F.col("status") == 200, "ok").when(again & (F.col("attempt") < attempts), "again").otherwise("failed")
        more = (F.col("page") >= pages) & F.col("next_token").isNotNull()
        split = (outcome == "ok") & more & (F.length("tile") < depth)
        got = checkpointed(got.select("region", "tile", "page", "token", "attempt", "places", "next_token", outcome.alias("outcome"), split.alias("split")))
        rounds.append(got)
        failed = got.where("outcome = 'failed'").select(F.col("region").alias("_f")).distinct()
        quarters = F.array(*[F.concat("tile", F.lit(str(q))) for q in range(4)])
        request = lambda df, tile, page, token, attempt: df.select("region", tile.alias("tile"), page.alias("page"), token.alias("token"), attempt.alias("attempt"))
        following = request(got.where(f"outcome = 'ok' AND page < {pages} AND next_token IS NOT NULL"), F.col("tile"), F.col("page") + 1, F.col("next_token"), F.lit(1))
        parted = request(got.where("split"), F.explode(quarters), F.lit(1), none, F.lit(1))
        retried = request(got.where("outcome = 'again'"), F.col("tile"), F.col("page"), F.col("token"), F.col("attempt") + 1)
        frontier = checkpointed(following.union(parted).union(retried).join(failed, F.col("region") == F.col("_f"), "left_anti"))
    every = rounds[0]
    for r in rounds[1:]:
        every = every.union(r)
    waited = F.when(F.col("outcome") == "again", F.lit(wait) * F.pow(F.lit(WAIT_GROWS), F.col("attempt") - 1)).otherwise(0.0)
    told = every.groupBy("region").agg(F.max(F.col("outcome") == "failed").alias("failed"), F.count(F.lit(1)).alias("n_requests"), F.count_if("split").alias("n_split"), F.sum(waited).alias("waited_s"))
    fine = told.where("NOT failed").select(F.col("region").alias("_r"))
    found = every.where("outcome = 'ok'").join(fine, F.col("region") == F.col("_r")).select("region", "tile", "page", F.posexplode("places").alias("nth", "place"))
    first = found.where("place.id IS NOT NULL").groupBy("region", F.col("place.id").alias("_id")).agg(F.min(F.struct("tile", "page", "nth", "place")).alias("p")).select("region", "p.tile", "p.page", "p.place")
    places = first.union(found.where("place.id IS NULL").select("region", "tile", "page", "place"))
    counts = places.groupBy(F.col("region").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    told = told.join(counts, F.col("region") == F.col("_r"), "left")
    return places, told.select("region", "failed", F.when(~F.col("failed"), F.coalesce("_n", F.lit(0))).alias("n_places"), "n_requests", "n_split", "waited_s")
