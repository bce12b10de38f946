"""Deeply nested records to flat child tables that keep their parent links.

The projection is higher-order SQL only: nested ``transform`` calls attach the
ancestor's key and position to every entry, ``flatten`` combines the arrays of
one level, and one ``inline`` for each target table emits the rows.  A row's
children come from its own text alone, so there is no shuffle and no group that
could grow hot.

Defined cases
  * null, blank or damaged text (cut off before its end): no rows;
  * a text encoded twice, a byte-order mark, Python literal notation: read;
  * one record in place of a list: position 0; a mapping, or several entries in
    one text ("a | b"): counted one by one in the order written;
  * a null entry is no record but keeps its position;
  * repeated rows each give their children; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.jsontext import entries, parse, readable, strings, trimmed

# The fields of the records, in either spelling of the app versions.
METRIC_FIELDS = ("candidates", "fn_reasons", "fnReasons", "fp_reasons", "fpReasons")
SUMMARY_FIELDS = ("decision_counts", "decisionCounts", "face", "face_fn_events", "faceFnEvents")
CONFIG_FIELDS = ("devices",)
EVENT = "struct<event:string,ts:string,track_id:string,trackId:string,name:string,old_name:string,oldName:string,new_name:string,newName:string,merge_target:string,mergeTarget:string,merge_score:double,mergeScore:double,votes:string>"
DEVICE = "struct<device:string,kind:string,channels:string>"
CHANNEL = "struct<no:bigint,gain_db:double,gainDb:double,muted:boolean>"
PAIR = "struct<name:string,score:double,n:double,count:double>"
COUNT = "struct<type:string,decision_type:string,decisionType:string,count:bigint>"
EVENT_KEYS = ("event", "ts", "track_id", "trackId", "votes")
DEVICE_KEYS = ("device", "kind", "channels")
CHANNEL_KEYS = ("no", "gain_db", "gainDb", "muted")

_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x["body"].isNotNull())


def _numbered(texts: Column) -> Column:
    return _present(F.transform(texts, lambda e, i: F.struct(i.alias("pos"), e.alias("body"))))


def _nothing(shape: str = "array<struct<pos:int,body:string>>") -> Column:
    return F.expr(f"cast(array() as {shape})")


def _kind(text: Column, opening: str) -> Column:
    return F.startswith(text, F.lit(opening))


def _split(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\|"), trimmed), lambda p: p != "")
    return _numbered(parts)


def record_items(text: Column, own_keys: tuple[str, ...]) -> Column:
    """Records with their positions: a list, one record alone, or a mapping of records."""
    members = entries(text)
    alone = F.arrays_overlap(F.transform(members, lambda m: m["key"]), F.array(*map(F.lit, own_keys)))
    return (
        F.when(_kind(text, "["), _numbered(strings(text)))
        .when(_kind(text, "{"), F.when(alone | (F.size(members) == 0), F.array(F.struct(F.lit(0).alias("pos"), text.alias("body")))).otherwise(_numbered(F.transform(members, lambda m: m["value"]))))
        .otherwise(_nothing())
    )


def reason_items(text: Column) -> Column:
    """Plain entries with their positions: a list, or one text with bars between the entries."""
    return F.when(text.isNull() | (text == ""), _nothing()).when(_kind(text, "["), _numbered(strings(text))).otherwise(_split(text))


_PAIRS = "array<struct<pos:int,body:string,key:string>>"


def pair_bodies(text: Column) -> Column:
    """Named numbers with their positions, unread: a list of pairs or records, one of them alone, or a mapping name → number."""
    bare = lambda items: F.transform(items, lambda x: F.struct(x["pos"].alias("pos"), x["body"].alias("body"), F.lit(None).cast("string").alias("key")))
    listed, members = strings(text), entries(text)
    one_pair = text.rlike(r'^\[\s*"') & (F.size(listed) == 2) & F.get(listed, F.lit(1)).rlike(_NUMBER)
    alone = F.array(F.struct(F.lit(0).alias("pos"), text.alias("body"), F.lit(None).cast("string").alias("key")))
    mapped = _present(F.transform(members, lambda m, i: F.struct(i.alias("pos"), m["value"].alias("body"), m["key"].alias("key"))))
    return (
        F.when(text.isNull() | (text == ""), _nothing(_PAIRS))
        .when(_kind(text, "["), F.when(one_pair, alone).otherwise(bare(_numbered(listed))))
        .when(_kind(text, "{"), F.when(text.rlike(r'"name"\s*:') & F.array_contains(F.transform(members, lambda m: m["key"]), "name"), alone).otherwise(mapped))
        .otherwise(bare(_split(text)))
    )


def _pair(x: Column) -> Column:
    """(pos, name, value) of ["name", 0.5], {"name": …, "score"|"n": …}, a mapping's member or a bare name."""
    body = x["body"]
    listed, record = strings(body), parse(body, PAIR)
    name = F.when(x["key"].isNotNull(), x["key"]).when(_kind(body, "["), F.get(listed, F.lit(0))).when(_kind(body, "{"), record["name"]).otherwise(body)
    value = F.when(x["key"].isNotNull(), body.try_cast("double")).when(_kind(body, "["), F.get(listed, F.lit(1)).try_cast("double")).when(_kind(body, "{"), F.coalesce(record["score"], record["n"], record["count"]))
    return F.struct(x["pos"].alias("pos"), name.alias("name"), value.alias("value"))


def pair_items(text: Column) -> Column:
    """Named numbers with their positions, names and values."""
    return F.transform(pair_bodies(text), _pair)


def count_items(text: Column) -> Column:
    """Counts by decision type: a mapping, a list of {type, count}, or one of these alone."""

    def of(body: Column) -> Column:
        record = parse(body, COUNT)
        return F.struct(F.coalesce(record["type"], record["decision_type"], record["decisionType"]).alias("type"), record["count"].alias("n"))

    members = entries(text)
    one = F.array_contains(F.transform(members, lambda m: m["key"]), "type")
    listed = F.transform(F.filter(strings(text), lambda e: e.isNotNull()), of)
    mapped = F.transform(F.filter(members, lambda m: m["value"].isNotNull()), lambda m: F.struct(m["key"].alias("type"), m["value"].try_cast("bigint").alias("n")))
    found = F.when(_kind(text, "["), listed).when(_kind(text, "{"), F.when(one, F.array(of(text))).otherwise(mapped)).otherwise(_nothing("array<struct<type:string,n:bigint>>"))
    return F.filter(found, lambda x: x["type"].isNotNull())


def _dotted(outer: Column, inner: Column) -> Column:
    return F.concat_ws(".", outer.cast("string"), inner.cast("string"))


def _children(parents: Column, child_text: Callable[[Column], Column], items: Callable[[Column], Column], row: Callable[[Column, Column], Column]) -> Column:
    """Entries of the entries: nested transform, then flatten."""
    return F.flatten(F.transform(parents, lambda p: F.transform(items(child_text(p["body"])), lambda c: row(p, c))))


def _tables(metrics: bool) -> dict[str, Callable[[], Column]]:
    c = F.col
    if metrics:
        reasons = lambda column: F.transform(reason_items(c(column)), lambda x: F.struct(x["pos"].cast("string").alias("pos"), x["body"].alias("reason")))
        return {
            "candidate": lambda: F.transform(pair_items(c("candidates")), lambda x: F.struct(x["pos"].cast("string").alias("pos"), x["name"].alias("name"), x["value"].alias("score"))),
            "fn_reason": lambda: reasons("fn_reasons"),
            "fp_reason": lambda: reasons("fp_reasons"),
        }

    def event(x: Column) -> Column:
        e = parse(x["body"], EVENT)
        either = lambda a, b: F.coalesce(e[a], e[b])
        return F.struct(
            x["pos"].cast("string").alias("pos"), e["event"].alias("event"), e["ts"].alias("ts"), either("track_id", "trackId").alias("track_id"), e["name"].alias("name"),
            either("old_name", "oldName").alias("old_name"), either("new_name", "newName").alias("new_name"),
            either("merge_target", "mergeTarget").alias("merge_target"), either("merge_score", "mergeScore").alias("merge_score"),
        )

    def device(x: Column) -> Column:
        d = parse(x["body"], DEVICE)
        return F.struct(x["pos"].cast("string").alias("pos"), d["device"].alias("device"), d["kind"].alias("kind"))

    def channel(p: Column, x: Column) -> Column:
        h = parse(x["body"], CHANNEL)
        return F.struct(_dotted(p["pos"], x["pos"]).alias("pos"), p["pos"].cast("string").alias("device_pos"), h["no"].alias("no"), F.coalesce(h["gain_db"], h["gainDb"]).alias("gain_db"), h["muted"].alias("muted"))

    vote = lambda p, x: F.struct(_dotted(p["pos"], x["pos"]).alias("pos"), p["pos"].cast("string").alias("event_pos"), x["name"].alias("name"), x["value"].cast("bigint").alias("n"))
    return {
        "decision_count": lambda: F.transform(count_items(c("decision_counts")), lambda x: F.struct(x["type"].alias("pos"), x["n"].alias("n"))),
        "face_event": lambda: F.transform(c("events"), event),
        "face_vote": lambda: _children(c("events"), lambda b: parse(b, "votes string")["votes"], pair_items, vote),
        "device": lambda: F.transform(c("device_items"), device),
        "channel": lambda: _children(c("device_items"), lambda b: parse(b, "channels string")["channels"], lambda t: record_items(t, CHANNEL_KEYS), channel),
    }


SEGMENT_CHILDREN = tuple(_tables(True))
SESSION_CHILDREN = tuple(_tables(False))


def _fields(names: tuple[str, ...]) -> str:
    return ",".join(f"{n} string" for n in names)


def read_metrics(segments: DataFrame) -> DataFrame:
    """parent_id and the list-valued parts of segments.metrics_json, as text."""
    doc = readable(segments.select(F.col("id").alias("parent_id"), F.col("metrics_json").alias("doc")), "doc")
    doc = doc.select("parent_id", F.when(_kind(F.col("doc"), "{"), parse(F.col("doc"), _fields(METRIC_FIELDS))).alias("m"))
    return doc.select("parent_id", F.col("m.candidates").alias("candidates"), F.coalesce("m.fn_reasons", "m.fnReasons").alias("fn_reasons"), F.coalesce("m.fp_reasons", "m.fpReasons").alias("fp_reasons"))


def read_sessions(sessions: DataFrame) -> DataFrame:
    """parent_id, decision counts, and the numbered face events and devices of each session."""
    docs = readable(sessions.select(F.col("id").alias("parent_id"), "summary", "config"), "summary", "config")
    read = lambda c, fields: F.when(_kind(F.col(c), "{"), parse(F.col(c), _fields(fields)))
    docs = docs.select("parent_id", read("summary", SUMMARY_FIELDS).alias("s"), read("config", CONFIG_FIELDS).alias("c"))
    docs = docs.select("parent_id", F.coalesce("s.decision_counts", "s.decisionCounts").alias("decision_counts"), parse(F.col("s.face"), "face_fn_events string, faceFnEvents string").alias("f"), F.coalesce("s.face_fn_events", "s.faceFnEvents").alias("flat_events"), F.col("c.devices").alias("devices"))
    docs = docs.select("parent_id", "decision_counts", F.coalesce("f.face_fn_events", "f.faceFnEvents", "flat_events").alias("event_text"), "devices")
    return docs.select("parent_id", "decision_counts", record_items(F.col("event_text"), EVENT_KEYS).alias("events"), record_items(F.col("devices"), DEVICE_KEYS).alias("device_items"))


def child_table(df: DataFrame, child: str) -> DataFrame:
    """The flat table of one kind of child: parent_id, pos and the record's own fields.

    ``df`` is ``segments`` for candidate, fn_reason and fp_reason, else ``sessions``.
    """
    metrics = child in SEGMENT_CHILDREN
    read = read_metrics(df) if metrics else read_sessions(df)
    return read.select("parent_id", F.inline(_tables(metrics)[child]()))


def _positions(metrics: bool) -> dict[str, Column]:
    """The positions of each kind of child, without reading the records."""
    c = F.col
    dotted = lambda parents, field, items: F.flatten(F.transform(parents, lambda p: F.transform(items(parse(p["body"], f"{field} string")[field]), lambda x: _dotted(p["pos"], x["pos"]))))
    plain = lambda items: F.transform(items, lambda x: x["pos"].cast("string"))
    if metrics:
        return {"candidate": plain(pair_bodies(c("candidates"))), "fn_reason": plain(reason_items(c("fn_reasons"))), "fp_reason": plain(reason_items(c("fp_reasons")))}
    return {
        "decision_count": F.transform(count_items(c("decision_counts")), lambda x: x["type"]),
        "face_event": plain(c("events")),
        "face_vote": dotted(c("events"), "votes", pair_bodies),
        "device": plain(c("device_items")),
        "channel": dotted(c("device_items"), "channels", lambda t: record_items(t, CHANNEL_KEYS)),
    }


def all_children(df: DataFrame, metrics: bool) -> DataFrame:
    """(child, parent_id, pos) of every child record of one table, in a single pass."""
    read = read_metrics(df) if metrics else read_sessions(df)
    tag = lambda child, rows: F.transform(rows, lambda pos: F.struct(F.lit(child).alias("child"), pos.alias("pos")))
    tagged = [tag(child, rows) for child, rows in _positions(metrics).items()]
    rows = read.select("parent_id", F.inline(F.concat(*tagged)))
    return rows.select("child", "parent_id", "pos")


def child_links(segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """One (child, parent_id, pos) row for each child record of both tables."""
    return all_children(segments, True).unionByName(all_children(sessions, False))
