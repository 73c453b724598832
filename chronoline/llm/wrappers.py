"""Main text of HTML pages by wrappers: union-free regular expressions inferred from the token streams of a host.

A page is read as a stream of the tags that hold others and of texts, each text with the path of its holders. Its
*shape* is this stream without the texts. Adjacent repeats in it fold into repeated groups. The shapes of a host, all of
them, are aligned one after the other: common items stay, what only some pages have becomes optional, a single
occurrence of what repeats elsewhere becomes a repeated group, and every text becomes a slot of the expression. Hosts
of many shapes are aligned in parts first, and the parts' expressions with each other.

Each shape is then matched against its host's wrapper, which gives each of a page's texts its slot, and sizes are summed
by slot over all pages. A slot decides for all its texts:

* in an element that HTML reserves for other things (nav, footer, aside, head ...), or a hidden one: not main text;
* in a header, form or element whose names say that it is something else (OUT_NAMES): not main text either, unless
  that element holds more than half of what the host's pages say outside of links: then the name means nothing;
* if the page has slots in article or main elements that are left, they are its main text;
* if not, slots of mostly links are not main text, nor are texts that at least SHARE of the host's distinct pages of that
  kind (3 or more of them) have in the same slot.

Null pages are empty; pages without content have an empty text; broken and truncated markup is read as far as it goes;
repeated rows are treated alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import drop_settled, frugal, release, settle, spread_join

UNIT, SHARE, PART, LINKS = 12, 0.75, 1_000, 0.6
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*\"?true", re.I)
#: Elements that break blocks, that hold others, that hold no main text (always, or unless they hold most
#: of it), and names of what is not main text.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()) - {"br"}
HOLDERS = set("article aside blockquote body dialog div dl fieldset figure footer form head header html main menu nav ol section table title ul".split())
NEVER = set("aside dialog footer head menu nav title".split())
SELDOM = set("form header".split())
OUT_NAMES = set("ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disclaimer disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notification pagination paywall popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget complementary contentinfo dialog".split())


def read(page: str) -> tuple[list[str], list[str], list[int]]:
    """The shape of a page, its texts in order (blocks in lines) and the characters of links in each.

    Items of a shape: `<name.words` and `>name.words` for elements that hold others (`!` behind the name: hidden), `#path` for texts.
    """
    shape, texts, linked = [], [], []
    open_: list[tuple[str, str]] = []
    lines: list[str] = []
    block: list[str] = []
    anchors, links = 0, 0

    def end_block():
        if block:
            line = " ".join(entities.unescape("".join(block)).split())
            if line:
                lines.append(line)
            block.clear()

    def end_text():
        nonlocal links
        end_block()
        if lines:
            shape.append("#" + "/".join(x[1] for x in open_))
            texts.append("\n".join(lines))
            linked.append(links)
            lines.clear()
        links = 0

    for m in TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            block.append(text)
            if anchors:
                links += len(text.strip())
            continue
        if not m.group(3):
            continue
        name = m.group(3).lower()
        if name == "a":
            anchors = 0 if m.group(2) else 1
        elif name == "br":
            block.append(" ")
        elif name in HOLDERS:
            end_text()
            if m.group(2):
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == name:
                        shape += [">" + x[1] for x in reversed(open_[k:])]
                        del open_[k:]
                        break
            else:
                attributes = m.group(4) or ""
                words = sorted({re.sub(r"\d+", "0", re.sub(r"[/#<>]", "", w)) for a in NAMED.findall(attributes) for w in "".join(a).lower().split()})
                sign = name + ("!" if attributes and HIDDEN.search(attributes) else "") + "".join("." + w for w in words)
                open_.append((name, sign))
                shape.append("<" + sign)
        elif name in BLOCKS:
            end_block()
    end_text()
    return shape, texts, linked


def items_of(shape: list[str]) -> list[tuple]:
    """The items of a shape, folded: (sign, leaves); leaves: for each text of the sign, the places of its texts."""
    items, at = [], 0
    for x in shape:
        items.append((x, ((at,),) if x[0] == "#" else ()))
        at += x[0] == "#"
    for width in range(1, UNIT + 1):
        out, i = [], 0
        signs = [x[0] for x in items]
        while i < len(items):
            n = 1
            while i + (n + 1) * width <= len(items) and signs[i + n * width : i + (n + 1) * width] == signs[i : i + width]:
                n += 1
            if n > 1 and not (width == 1 and (isinstance(signs[i], tuple) or signs[i][0] == ">")):
                out.append(grouped([items[i + k * width : i + (k + 1) * width] for k in range(n)]))
                i += n * width
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def grouped(copies: list[list[tuple]]) -> tuple:
    """One repeated group of the occurrences of a unit."""
    leaves = [[leaf for x in unit for leaf in x[1]] for unit in copies]
    return ("+", *(x[0] for x in copies[0])), tuple(tuple(p for unit in leaves for p in unit[k]) for k in range(len(leaves[0])))


def expanded(items: list, units: set) -> list:
    """Single occurrences of units that repeat elsewhere, as repeated groups too; anything behind sign and leaves stays."""
    sizes = sorted({len(u) - 1 for u in units}, reverse=True)
    out, i = [], 0
    while i < len(items):
        for n in sizes:
            part = items[i : i + n]
            if ("+", *(x[0] for x in part)) in units and len(part) == n:
                out.append((*grouped([[x[:2] for x in part]]), *([any(x[2] for x in part)] if len(part[0]) > 2 else [])))
                i += n
                break
        else:
            out.append(items[i])
            i += 1
    return out


class Blocks(difflib.SequenceMatcher):
    """Python's matcher of longest common blocks without its rule for frequent items, which long sequences lose.

    Its search for one block takes time by the pairs of equal items. Where these are many for the lengths, an automaton
    of all substrings finds the same block in linear time: the longest, of these the first in a, then the first in b.
    """

    def __init__(self, a: list[str], b: list[str]):
        super().__init__(None, a, b, autojunk=False)

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if sum(len(self.b2j.get(x, ())) for x in self.a[alo:ahi]) <= 16 * (ahi - alo + bhi - blo):
            return super().find_longest_match(alo, ahi, blo, bhi)
        return longest(self.a, alo, ahi, self.b, blo, bhi)


def longest(a: list[str], alo: int, ahi: int, b: list[str], blo: int, bhi: int) -> difflib.Match:
    """The longest block that a[alo:ahi] and b[blo:bhi] share, of equally long ones the first in a, then the first in b."""
    step: list[dict[str, int]] = [{}]
    link, length, first = [-1], [0], [0]  # first: behind the first occurrence in b
    last = 0
    for j in range(blo, bhi):
        x, state, at = b[j], len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(j + 1)
        while at >= 0 and x not in step[at]:
            step[at][x] = state
            at = link[at]
        if at >= 0:
            to = step[at][x]
            if length[to] > length[at] + 1:
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                first.append(first[to])
                old, to = to, len(step) - 1
                while at >= 0 and step[at].get(x) == old:
                    step[at][x] = to
                    at = link[at]
                link[old] = to
            link[state] = to
        last = state
    best, at, size = (alo, blo, 0), 0, 0
    for i in range(alo, ahi):
        while at and a[i] not in step[at]:
            at = link[at]
            size = length[at]
        if a[i] in step[at]:
            at, size = step[at][a[i]], size + 1
        if size > best[2]:
            best = (i + 1 - size, first[at] - size, size)
    return difflib.Match(*best)


def align(wrapper: list[tuple], page: list[tuple]) -> tuple[list[tuple], dict]:
    """The wrapper (sign, slots, optional) generalised to the page (sign, leaves[, optional]), and the slot of each place of the page."""
    units = {x[0] for side in (wrapper, page) for x in side if isinstance(x[0], tuple)}
    left, right = expanded(wrapper, units), expanded(page, units)
    slots = 1 + max((s for x in left for leaf in x[1] for s in leaf), default=-1)
    out, where = [], {}
    for op, a, b, c, d in Blocks([repr(x[0]) for x in left], [repr(x[0]) for x in right]).get_opcodes():
        if op == "equal":
            for x, y in zip(left[a:b], right[c:d]):
                out.append((x[0], x[1], x[2] or (len(y) > 2 and y[2])))
                where |= {place: leaf[0] for leaf, places in zip(x[1], y[1]) for place in places}
        else:
            out += [(x[0], x[1], True) for x in left[a:b]]
            for y in right[c:d]:
                own = tuple((slots + k,) for k in range(len(y[1])))
                slots += len(own)
                where |= {place: leaf[0] for leaf, places in zip(own, y[1]) for place in places}
                out.append((y[0], own, True))
    return out, where


def plain(items: list[tuple]) -> list[tuple]:
    """Items of a page as a wrapper of its own."""
    out, slots = [], 0
    for x in items:
        out.append((x[0], tuple((slots + k,) for k in range(len(x[1]))), len(x) > 2 and x[2]))
        slots += len(x[1])
    return out


def infer(pages: list[list[tuple]]) -> list[tuple]:
    """The wrapper of all pages (items), or of wrappers, aligned one after the other."""
    wrapper = plain(pages[0]) if pages else []
    for page in pages[1:]:
        wrapper = align(wrapper, page)[0]
    return wrapper


def dump(wrapper: list[tuple]) -> str:
    return json.dumps(wrapper)


def load(text: str) -> list[tuple]:
    sign = lambda x: x if isinstance(x, str) else tuple(sign(y) for y in x)
    return [(sign(a), tuple(tuple(x) for x in b), c) for a, b, c in json.loads(text)]


def show(wrapper: list[tuple]) -> str:
    """A wrapper as a regular expression over tags and texts (#)."""

    def one(sign) -> str:
        if isinstance(sign, tuple):
            return f"({''.join(map(one, sign[1:]))})+"
        return "#" if sign[0] == "#" else f"</{sign[1:].split('.')[0]}>" if sign[0] == ">" else sign + ">"

    return "".join(f"({one(sign)})?" if optional else one(sign) for sign, _, optional in wrapper)


def paths(wrapper: list[tuple]) -> dict[int, str]:
    """The path of each slot."""

    def texts(sign):
        return [sign[1:]] if isinstance(sign, str) and sign[0] == "#" else [p for x in sign[1:] for p in texts(x)] if isinstance(sign, tuple) else []

    return {s: path for sign, leaves, _ in wrapper for leaf, path in zip(leaves, texts(sign)) for s in leaf}


def verdicts(path_of: dict[int, str], chars: dict[int, int], links: dict[int, int]) -> dict[int, str]:
    """For each slot 'm' (in an article or main element), 't' (other text), 'l' (mostly links) or '-' (not main text)."""
    mass: dict[tuple, int] = {}
    total = 0
    for s, path in path_of.items():
        own = max(0, chars.get(s, 0) - links.get(s, 0))
        total += own
        steps = path.split("/")
        for k in range(1, len(steps) + 1):
            mass[tuple(steps[:k])] = mass.get(tuple(steps[:k]), 0) + own

    def out(steps: tuple) -> bool:
        name, *words = steps[-1].split(".")
        if name.rstrip("!") in NEVER:
            return True
        named = name.endswith("!") or name in SELDOM or any(part in OUT_NAMES for w in words for part in [*re.split(r"[-_]", w), w])
        return named and 2 * mass[steps] <= total

    found = {}
    for s, path in path_of.items():
        steps = path.split("/") if path else []
        main = any(x.split(".")[0].rstrip("!") in ("article", "main") or "main" in x.split(".")[1:] for x in steps)
        if any(out(tuple(steps[:k])) for k in range(1, len(steps) + 1)):
            found[s] = "-"
        else:
            found[s] = "m" if main else "l" if links.get(s, 0) > LINKS * chars.get(s, 0) else "t"
    return found


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _read(batches):
    for batch in batches:
        rows = [read(x) if x else ([], [], []) for x in batch.column(3).to_pylist()]
        shapes = pa.array([json.dumps(r[0], separators=(",", ":")) for r in rows], pa.string())
        arrays = [shapes, pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([[len(t) for t in r[1]] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=["page_id", "url", "host", "shape", "texts", "chars", "links"])


def streams(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, shape, texts, chars, links) of every page."""
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    schema = named.drop("html").withColumns({"shape": F.lit(""), "texts": F.array(F.lit("")), "chars": F.array(F.lit(0).cast("long")), "links": F.array(F.lit(0).cast("long"))}).schema
    return named.mapInArrow(frugal(_read), schema)


def _infer(column: str):
    def run(table: pa.Table) -> pa.Table:
        order = sorted(table.column(column).to_pylist())
        found = infer([items_of(json.loads(x)) if column == "shape" else load(x) for x in order])
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([dump(found)])})

    return run


def wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of each host, from all its distinct shapes (host, shape), settled.

    Shapes of a host are dealt to parts of about PART and aligned there; then the parts' wrappers are aligned.
    """
    parts = shapes.groupBy("host").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("w"))
    dealt = spread_join(shapes.select("host", "shape"), settle(parts), ["host"], "w", ["shape"]).withColumn("part", F.pmod(F.xxhash64("shape"), "parts").cast("int"))
    first = dealt.groupBy("host", "part").applyInArrow(_infer("shape"), "host string, wrapper string")
    return settle(first.groupBy("host").applyInArrow(_infer("wrapper"), "host string, wrapper string"))


def _match(batches):
    """(host, shape, wrapper) to (host, shape, slots, paths): the slot and its path for each place of the shape."""
    known: tuple[str | None, list, dict] = (None, [], {})
    for batch in batches:
        slots, found = [], []
        for shape, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if known[0] != text:
                wrapper = load(text)
                known = text, wrapper, paths(wrapper)
            places = json.loads(shape)
            _, where = align(known[1], items_of(places))
            path = [x[1:] for x in places if x[0] == "#"]
            # a text that the final alignment places nowhere has the slot of its path
            slots.append([where[k] if where[k] in known[2] else (1 << 30) | zlib.crc32(x.encode()) >> 2 for k, x in enumerate(path)])
            found.append(path)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=["host", "shape", "slots", "paths"])


def _decide(table: pa.Table) -> pa.Table:
    slots, path, chars, links = (table.column(c).to_pylist() for c in ("slot", "path", "chars", "links"))
    found = verdicts(dict(zip(slots, path)), dict(zip(slots, chars)), dict(zip(slots, links)))
    return pa.table({"host": table.column("host"), "slot": table.column("slot"), "verdict": pa.array([found[s] for s in slots], pa.string())})


def decisions(pages: DataFrame, shapes: DataFrame, wrapper: DataFrame) -> DataFrame:
    """(host, shape, n, slots, verdict) for every shape: a slot and a letter of its verdict for each text of its pages."""
    width = settle(shapes.groupBy("host").agg(F.count("*").alias("w")).join(wrapper, "host"))
    matched = settle(spread_join(shapes.select("host", "shape"), width, ["host"], "w", ["shape"]).select("host", "shape", "wrapper").mapInArrow(frugal(_match), "host string, shape string, slots array<int>, paths array<string>"))
    sizes = pages.select("host", "shape", F.posexplode(F.arrays_zip("chars", "links")).alias("at", "e")).groupBy("host", "shape", "at").agg(F.sum("e.chars").alias("chars"), F.sum("e.links").alias("links"))
    places = settle(matched.select("host", "shape", F.posexplode(F.arrays_zip("slots", "paths")).alias("at", "e")).select("host", "shape", "at", F.col("e.slots").alias("slot"), F.col("e.paths").alias("path")))
    by_slot = places.join(sizes, ["host", "shape", "at"]).groupBy("host", "slot").agg(F.min("path").alias("path"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    decided = settle(by_slot.groupBy("host").applyInArrow(_decide, "host string, slot int, verdict string"))
    letters = places.join(decided, ["host", "slot"]).groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("at", "slot", "verdict"))).alias("e"))
    out = settle(shapes.join(letters, ["host", "shape"], "left").select("host", "shape", "n", F.coalesce("e.slot", F.array().cast("array<int>")).alias("slots"), F.coalesce(F.array_join("e.verdict", ""), F.lit("")).alias("verdict")))
    for table in (width, matched, places, decided):
        drop_settled(table)
    return out


def templates(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """(host, template): hashes of slot and line that at least SHARE of a host's distinct pages without main slots have."""
    bare = settle(decided.where("verdict not like '%m%' and verdict like '%t%'"))
    kind = spread_join(pages.select("host", "shape", "texts"), bare, ["host", "shape"], "n", [F.col("texts")]).dropDuplicates(["host", "shape", "texts"])
    line = F.flatten(F.zip_with("slots", "texts", lambda s, t: F.transform(F.split(t, "\n"), lambda x: F.xxhash64(s, x))))
    kind = settle(kind.select("host", F.array_distinct(line).alias("lines")))
    sizes = kind.groupBy("host").agg(F.count("*").alias("pages")).where("pages > 2")
    counts = kind.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("times"))
    found = settle(counts.join(sizes, "host").where(F.col("times") >= SHARE * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("template")))
    drop_settled(bare)
    drop_settled(kind)
    return found


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    read_pages = settle(streams(pages.select("page_id", "url", "html")))
    shapes = settle(read_pages.groupBy("host", "shape").agg(F.count("*").alias("n")))
    wrapper = wrappers(shapes)
    decided = decisions(read_pages, shapes, wrapper)
    known = settle(decided.join(templates(read_pages, decided), "host", "left"))
    for table in (shapes, wrapper, decided):
        drop_settled(table)
    release(spark)
    joined = spread_join(read_pages.drop("chars", "links"), known, ["host", "shape"], "n", [F.col("page_id")], "left")
    letter = lambda i: F.substring("verdict", i + 1, 1)
    has_main = F.col("verdict").contains("m")
    lines = lambda t, s: F.filter(F.split(t, "\n"), lambda x: ~F.array_contains("template", F.xxhash64(s, x)))
    whole = F.zip_with("texts", "slots", lambda t, s: F.when(has_main | F.col("template").isNull(), t).otherwise(F.array_join(lines(t, s), "\n")))
    kept = F.filter(whole, lambda t, i: (F.substr(F.col("verdict"), i + 1, F.lit(1)) == F.when(has_main, "m").otherwise("t")) & (t != ""))
    text = F.coalesce(F.array_join(kept, "\n"), F.lit(""))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
