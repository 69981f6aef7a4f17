"""Multichannel audio labels: links between channels, soundfield groups and groups of these."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_labels(text: str) -> Iterator[dict]:
    """Blocks separated by blank lines: a track index, then a line per label: ``tag, name=value, ...``; ``#`` starts a comment.

    A backslash keeps the character after it.
    """
    track = None
    for raw in text.splitlines():
        line = _uncommented(raw)
        if not line.strip():
            track = None if not raw.strip() else track
        elif track is None:
            if not line.strip().isdigit():
                raise ValueError(f"expected a track index, not {line.strip()!r}")
            track = int(line)
        else:
            tag, *rest = _split(line, ",")
            props = {}
            for item in rest:
                name, *value = _split(item, "=")
                if len(value) != 1:
                    raise ValueError(f"expected name=value, not {item.strip()!r}")
                props[name.strip()] = value[0].strip()
            yield {"track": track, "tag": tag.strip(), "props": props}


def _uncommented(line: str) -> str:
    out = 0
    while out < len(line) and line[out] != "#":
        out += 2 if line[out] == "\\" else 1
    return line[:out]


def _split(text: str, mark: str) -> list[str]:
    parts, kept = [""], False
    for c in text:
        if kept:
            parts[-1] += c
            kept = False
        elif c == "\\":
            kept = True
        elif c == mark:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def broken_links(labels: DataFrame, link: str, targets: DataFrame, target: str) -> DataFrame:
    """Labels whose link names a label that isn't there."""
    return labels.where(F.col(link).isNotNull()).join(targets.select(F.col(target).alias(link)).distinct(), link, "left_anti")


def referenced(groups: DataFrame, group_id: str, labels: DataFrame, link: str) -> DataFrame:
    """Groups that some label points at."""
    return groups.join(labels.select(F.col(link).alias(group_id)).distinct(), group_id, "left_semi")


def identity_problems(labels: DataFrame) -> DataFrame:
    """Ids (label_id, dict_id, props as a string) that stand for different things."""
    known = labels.where("label_id is not null").groupBy("label_id").agg(F.count_distinct("dict_id").alias("dict_ids"), F.count_distinct("props").alias("properties"))
    return known.where("dict_ids > 1 or properties > 1")


def once_per_track(labels: DataFrame) -> DataFrame:
    """Labels of which a track has each id once: the first."""
    w = Window.partitionBy("track", "label_id").orderBy("seq")
    return labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def channel_problems(labels: DataFrame, channels: DataFrame) -> DataFrame:
    """Channel labels without an index in tracks of several channels, or with one beyond the last; stored ids are index + 1."""
    joined = labels.join(channels, "track")
    bad = (F.col("channel").isNull() & (F.col("channels") > 1)) | (F.col("channel") >= F.col("channels"))
    return joined.withColumn("channel_id", F.col("channel") + 1).where(bad)


def insert_labels(lines: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """What label lines (key, track, seq, tag, id, repeat, channel, props) put into a file's tracks, with the links between them.

    ``symbols`` (tag, kind, name) says which tags are channels (``ch``), soundfield groups (``sg``) and groups of these (``gg``).  Channels belong to the soundfield group
    that follows them in their track, and a group of groups to those since the last channel.  Labels of one ``id`` in a file are one label: the first has the properties
    and the links, and a later one is stored again, once a track, unless ``repeat`` is false.

    A row for each line: ``kind, name``, ``label`` (the seq of the line that stands for it), ``stored``, ``channel_id`` (from 1), ``group`` (a channel's soundfield
    group), ``groups`` (a soundfield group's groups, in order), ``inherited`` (its properties) and ``problem``.  ``seq`` orders a file's lines; it is unique in a file.
    """
    kinds = F.broadcast(symbols.select("tag", "kind", "name"))  # a row for each tag
    rows = lines.join(kinds, "tag", "left").withColumn("kind", F.coalesce("kind", F.lit(""))).repartition(key)  # all windows are within a file
    here = Window.partitionBy(key, "track").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda kind: (F.col("kind") == kind).cast("long")
    rows = rows.withColumn("_sgs", F.sum(of("sg")).over(here))
    rows = rows.withColumn("_before", F.coalesce(F.last(F.when(F.col("kind") == "ch", F.col("_sgs")), ignorenulls=True).over(here), F.lit(0).cast("long")))
    channels = F.count_if(F.col("kind") == "ch").over(Window.partitionBy(key, "track", F.when(F.col("kind") == "ch", F.col("_sgs") + 1).when(F.col("kind") == "sg", F.col("_sgs"))))

    named = F.col("kind").isin("sg", "gg") & F.col("id").isNotNull()
    one = Window.partitionBy(key, F.when(named, F.col("id")), F.when(~named, F.col("seq")), F.when(named, F.col("kind"))).orderBy("seq")
    in_track = Window.partitionBy(key, "track", F.when(named, F.col("id")), F.when(~named, F.col("seq")), F.when(named, F.col("kind"))).orderBy("seq")
    first = lambda c: F.first(c).over(one)
    rows = rows.withColumns({
        "label": first("seq"), "_tag": first("tag"), "inherited": first("props"), "_track": first("track"), "_nth": F.row_number().over(in_track), "_channels": channels,
    })
    is_first = F.col("label") == F.col("seq")
    again = F.coalesce(F.col("repeat"), F.lit(True)) & (F.col("_nth") == 1) & (F.col("_track") != F.col("track"))
    rows = rows.withColumn("stored", (F.col("kind") != "") & (is_first | again))
    later = Window.partitionBy(key, "track").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("group", F.when(F.col("kind") == "ch", F.last(F.when(F.col("kind") == "sg", F.col("label")), ignorenulls=True).over(later)))

    groups = rows.where("kind = 'sg'").select(key, "track", F.col("_sgs").alias("_sg"), F.col("seq").alias("_seq"), F.col("label").alias("_label"))
    over = rows.where("kind = 'gg'").select(key, "track", F.col("label").alias("_gg"), F.explode(F.when(F.col("_sgs") > F.col("_before"), F.sequence(F.col("_before") + 1, F.col("_sgs")))).alias("_sg"))
    above = over.join(groups, [key, "track", "_sg"]).groupBy(key, F.col("_seq").alias("seq")).agg(F.sort_array(F.collect_set("_gg")).alias("groups"))
    rows = rows.join(above, [key, "seq"], "left").withColumn("_first_groups", F.first("groups").over(one))

    differs = F.exists(F.map_keys("props"), lambda name: ~F.coalesce(F.element_at("props", name) == F.element_at("inherited", name), F.lit(False)))
    problem = (
        F.when(F.col("kind") == "", "no such label").when(F.col("_tag") != F.col("tag"), "one id for different labels").when(~is_first & F.coalesce(differs, F.lit(False)), "other properties than the first of its id")
        .when((F.col("kind") == "sg") & ~is_first & F.col("groups").isNotNull() & ~F.coalesce(F.col("groups") == F.col("_first_groups"), F.lit(False)), "other groups than the first of its id")
        .when((F.col("kind") == "sg") & (F.col("_channels") == 0), "no channels in a soundfield group").when((F.col("kind") == "gg") & (F.col("_sgs") == F.col("_before")), "no soundfield group before it")
    )
    own = F.when(F.col("kind") == "sg", F.coalesce(F.when(is_first, F.col("groups")).otherwise(F.col("_first_groups")), F.array().cast("array<long>")))
    channel = F.when(F.col("kind") == "ch", F.col("channel") + 1)
    return rows.select(key, "track", "seq", "kind", "name", "label", "stored", channel.alias("channel_id"), "group", own.alias("groups"), "inherited", problem.alias("problem"))
