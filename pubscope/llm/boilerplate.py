"""Main content of web pages by wrapper induction over the pages of a host.

A page is a tree of two levels: its blocks in order, and the parts of a block that lists links. The pages of a host are
aligned by simple tree matching with the host's template, which holds the nodes that are constant over its pages; nodes
that match are furniture, and what stands in the slots between them varies. A list of links matches through its parts.

What fills a slot is judged by statistics of the slots, not by how it is worded. Sentences are text. A block without a
full stop is a label, and the corpus shows what that label is: a section heading stands between text, a teaser, a date
or a title in a box stands among other labels, and a byline stands in the slot under the title, which holds many
different values, while a heading that opens pages comes back. A block as long as text is, among text, is text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubscope.functions.text import INVISIBLE, clean_text, fold_py
from pubscope.session import cut, small

#: A node is constant if it is expected on more than this share of the host's pages.
CONSTANT = 0.5
#: Pages that what is known from other hosts counts as, and the share of a node that no other host has.
OTHER_HOSTS, UNKNOWN = 3.0, 0.1
#: A sentence on this share of all pages, over several hosts, is a notice and not somebody's prose.
NOTICE_SHARE, NOTICE_PAGES, NOTICE_HOSTS = 0.01, 5, 3
#: A sentence on one page of its host is a notice by what other hosts show if at least so many have it; fewer may be sister pages.
ALIKE_HOSTS = 5
#: A label is a heading if text follows it on more than this share, and stands before it on more than this share of its places.
HEADING_NEXT, HEADING_PREV = 0.5, 0.3
#: One only seen right under the title is a heading if it is this share of what its host has there, or there on so many hosts,
#: or if its host has something there on less than this share of its pages, so that the place is none for bylines.
OPENING_SHARE, OPENING_HOSTS, OPENING_FILLED = 0.25, 3, 0.25
#: A part of a list of links is one of the host's labels if it stands in such lists on so many pages and on this share of them.
PART_PAGES, PART_SHARE = 2, 0.01

# Marks that end a sentence (but for an ellipsis, which breaks one off), that begin an item, that part links.
_PROSE = re.compile(r"(?<!\.\.)[.!?؟。！？।][\"”’»'“)\]]*$")
_BROKEN = re.compile(r"…|\.\.\.")
_BULLET = re.compile(r"^(?:[•‣▪◦●*–—-]\s+|\(?\d{1,2}[.)]\s+\S|\(?[a-z]\)\s)")
_PARTS = re.compile(r"\s+[·|›»>/•–]\s+|\s{2,}(?=→)")

TEMPLATE, BLANK, LINKS, TITLE, PROSE, BULLET, LABEL, NOTICE = "TBLNPUSX"
#: Where a label stands: after text, under the title or at the start (alone or after one other label), among labels.
TEXT_BEFORE, OPENING, AMONG = "tol"

_NODES = "row long, page_id long, host string, title string, url string, blocks array<string>, keys array<long>, nth array<int>, parts array<struct<b:string,keys:array<bigint>>>"
_PAGE = "row long, page_id long, host string, sure array<int>, prose array<int>, labels array<struct<i:int,key:long,before:string,follows:boolean,raw:boolean,under:long,words:int>>"


def match(page: list[int], template: list[int]) -> set[int]:
    """Simple tree matching of two one-level trees: indices of the page's nodes in a longest common ordered matching.

    Of several that are longest, the one with most nodes that also follow each other in the template, or stand at an end
    of both: a block of the body that is spelled like a node of the template doesn't take that node's place.
    """
    fixed = set(template)
    nodes = [i for i, k in enumerate(page) if k in fixed]
    m, one = len(template), len(page) + 2  # a matched node outweighs all neighbourhoods
    best = [[0] * (m + 1)]  # of the first nodes and the first template nodes
    ends: list[list[int]] = [[-1] * (m + 1)]  # the same, where the last two are matched; -1: they aren't
    for a, i in enumerate(nodes):
        row, end, near = [0] * (m + 1), [-1] * (m + 1), a > 0 and nodes[a - 1] == i - 1
        for j in range(m):
            row[j + 1] = max(row[j], best[a][j + 1])
            if template[j] == page[i]:
                before = max(best[a][j], ends[a][j] + 1 if near and ends[a][j] >= 0 else 0, int(i == 0 and j == 0))
                end[j + 1] = before + one + int(i == len(page) - 1 and j == m - 1)
                row[j + 1] = max(row[j + 1], end[j + 1])
        best.append(row)
        ends.append(end)
    out, a, j, held = set(), len(nodes), m, False
    while a and j:
        if held or best[a][j] == ends[a][j]:
            i = nodes[a - 1]
            out.add(i)
            before = ends[a][j] - one - int(i == len(page) - 1 and j == m)
            held = a > 1 and nodes[a - 2] == i - 1 and ends[a - 1][j - 1] >= 0 and ends[a - 1][j - 1] + 1 == before
            a, j = a - 1, j - 1
        elif best[a][j] == best[a - 1][j]:
            a -= 1
        else:
            j -= 1
    return out


def slug_start(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", fold_py(text)).strip("-")


_GONE, _INVISIBLE = str.maketrans("", "", INVISIBLE), re.compile(f"[{INVISIBLE}]")
_DIGITS = re.compile(b"[0-9]+")
_HOST_NAME = re.compile("[a-z0-9-]{5,}")


def node_key(block: str, name: bytes) -> int:
    """A node's key: the hash of its folded text, digits masked, and the site's own name too, so that other hosts' notices compare.

    Folded: in lower case without accents; a text that is mostly of another script keeps its letters.
    """
    low = block.lower()
    folded = low.encode() if low.isascii() else unicodedata.normalize("NFKD", low).encode("ascii", "ignore")
    if 2 * len(folded) < len(low):
        folded = low.encode("utf-8", "surrogatepass")
    if name:
        folded = folded.replace(name, b"@")
    h = xxhash.xxh64_intdigest(_DIGITS.sub(b"#", folded))
    return h - (1 << 64) if h >> 63 else h


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as trees: cleaned blocks, their keys, how many nodes of that key they complete (0: blank), and the parts of those that list links."""
    part = pa.struct([("b", pa.string()), ("keys", pa.list_(pa.int64()))])
    names, types = [x.split()[0] for x in _NODES.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(part)]
    for b in batches:
        out: list[list] = [[], [], [], []]
        for host, paragraphs in zip(b.column(2).to_pylist(), b.column(5).to_pylist()):
            labels = host.split(".")
            name = labels[-2].encode() if len(labels) > 1 and _HOST_NAME.fullmatch(labels[-2]) else b""
            blocks = [" ".join((x.translate(_GONE) if _INVISIBLE.search(x) else x).split()) if x else "" for x in paragraphs]
            keys = [node_key(x, name) for x in blocks]
            seen: dict[int, int] = {}
            nth = []
            for x, k in zip(blocks, keys):
                if x:
                    seen[k] = seen.get(k, 0) + 1
                nth.append(seen[k] if x else 0)
            parts = [{"b": x, "keys": [node_key(y, name) for y in _PARTS.split(x)]} for x in blocks if x and _PARTS.search(x) and not _PROSE.search(x)]
            for column, value in zip(out, (blocks, keys, nth, parts)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*b.columns[:5], *[pa.array(c, t) for c, t in zip(out, types[5:])]], names=names)


def classify(blocks: list[str], keys: list[int], template: list[int], title: str, url: str, notices: frozenset[int], parts: dict[str, list[int]], known: frozenset[int]) -> list[str]:
    """The kind of each (cleaned) block of a page. ``parts``: the keys of the parts of blocks that list links."""
    filled = [i for i, b in enumerate(blocks) if b]
    constant = {filled[i] for i in match([keys[i] for i in filled], template)}
    tail = re.sub(r"-\d+$", "", url.rstrip("/").rpartition("/")[2].split("?")[0]) if url else ""

    def titled(text: str) -> bool:
        return text == title or (len(tail) > 7 and slug_start(text)[: len(tail)] == tail)

    out = []
    for i, (b, k) in enumerate(zip(blocks, keys)):
        if not b:
            kind = BLANK
        elif i in constant:
            kind = TEMPLATE
        elif b == title or (not title and titled(b)):
            kind = TITLE
        elif _BULLET.match(b) and not _BROKEN.search(b):
            kind = BULLET
        elif _PROSE.search(b):
            kind = NOTICE if k in notices else PROSE
        elif b in parts and (titled(_PARTS.split(b)[-1]) or sum(x not in known for x in parts[b]) <= 1 < len(parts[b])):
            kind = LINKS
        else:
            kind = LABEL
        out.append(kind)
    return out


def places(kinds: list[str]) -> list[tuple[int, str, bool, bool, int | None]]:
    """Where the labels of a page stand.

    Index, what is before, does text follow, is the block right before text, title or a label right under it, and which
    block that label is.
    """
    text = (PROSE, BULLET)
    order = [i for i, k in enumerate(kinds) if k not in (BLANK, TEMPLATE, LINKS, NOTICE)]
    shown = [k for k in kinds if k != BLANK]
    rank = {i: n for n, i in enumerate(i for i, k in enumerate(kinds) if k != BLANK)}
    out = []
    for n, i in enumerate(order):
        if kinds[i] != LABEL:
            continue
        prev = kinds[order[n - 1]] if n else TITLE
        if prev == LABEL and (n == 1 or kinds[order[n - 2]] == TITLE):
            before = OPENING
        else:
            before = TEXT_BEFORE if prev in text else OPENING if prev == TITLE else AMONG
        nxt = kinds[order[n + 1]] if n + 1 < len(order) else ""
        at = rank[i]
        under = order[n - 1] if prev == LABEL and before == OPENING and at > 0 and shown[at - 1] == LABEL else None
        out.append((i, before, nxt in text, at > 0 and (shown[at - 1] in (*text, TITLE) or under is not None), under))
    return out


def _classify(notices: frozenset[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    label = pa.struct([("i", pa.int32()), ("key", pa.int64()), ("before", pa.string()), ("follows", pa.bool_()), ("raw", pa.bool_()), ("under", pa.int64()), ("words", pa.int32())])
    schema = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("host", pa.string()), ("sure", pa.list_(pa.int32())), ("prose", pa.list_(pa.int32())), ("labels", pa.list_(label))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, page, host, blocks, keys, part_keys, template, title, url, alike, known in zip(*(b.column(c).to_pylist() for c in range(11))):
                lists = {p["b"]: p["keys"] for p in part_keys}
                kinds = classify(blocks, keys, template or [], title or "", url or "", notices.union(alike) if alike else notices, lists, frozenset(known or ()).union(template or ()))
                labels = [(i, keys[i], before, follows, raw, None if under is None else keys[under], len(blocks[i].split())) for i, before, follows, raw, under in places(kinds)]
                sure = [i for i, k in enumerate(kinds) if k in (PROSE, BULLET)]
                rows.append((row, page, host, sure, [len(blocks[i].split()) for i in sure if kinds[i] == PROSE], labels))
            cols = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, f.type) for c, f in zip(cols[:5], schema)]
            flat = [x for r in cols[5] for x in r]
            ends = [0]
            for r in cols[5]:
                ends.append(ends[-1] + len(r))
            fields = [pa.array(c, f.type) for c, f in zip(list(zip(*flat)) or [()] * 7, label)]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(label)), type=pa.list_(label)))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _templates(keyed: DataFrame, constant: DataFrame) -> DataFrame:
    """host, template: the constant nodes of each host in the order that its pages, aligned with each other, have them in.

    Of two nodes, the one that stands first on more pages is the earlier; a node's place is the number of nodes it is
    later than, less those it is earlier than. Pages whose constant nodes are the same count together.
    """
    wanted = constant.groupBy("host").agg(F.collect_set(F.struct("key", "nth")).alias("wanted"))
    nodes = F.transform(F.arrays_zip("keys", "nth"), lambda x: F.struct(x["keys"].alias("key"), x["nth"].alias("nth")))
    held = keyed.join(small(wanted), "host").select("host", F.array_intersect(nodes, "wanted").alias("line"))
    lines = held.groupBy("host", "line").agg(F.count("*").alias("n"))
    first = lines.select("host", "line", "n", F.posexplode("line").alias("i", "a"))
    pairs = first.select("host", "n", "a", F.explode(F.slice("line", F.col("i") + 2, F.size("line"))).alias("b"))
    ahead = pairs.select("host", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(-F.col("n")).alias("n"))
    won = ahead.groupBy("host", "x", "y").agg(F.signum(F.sum("n")).alias("sign"))
    sides = won.select("host", F.col("x").alias("node"), (-F.col("sign")).alias("sign")).unionByName(won.select("host", F.col("y").alias("node"), "sign"))
    place = sides.groupBy("host", "node").agg(F.sum("sign").alias("place"))
    all_ = constant.select("host", F.struct("key", "nth").alias("node")).join(place, ["host", "node"], "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("place", F.lit(0.0)).alias("place"), F.col("node.nth").alias("nth"), F.col("node.key").alias("key"))))
    return all_.groupBy("host").agg(F.transform(order, lambda x: x["key"]).alias("template"))


def _headings(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """row, i of the labels that are section headings, by where labels of their key stand in the whole corpus."""
    stats = labels.groupBy("key").agg(
        F.avg(F.col("follows").cast("int")).alias("after"),
        F.count_if(F.col("before") == TEXT_BEFORE).alias("inside"),
        F.count_if(F.col("before") == AMONG).alias("among"),
    )
    likely = cut(stats.where(F.col("after") > HEADING_NEXT), "labels")
    inside = likely.where((F.col("inside") + F.col("among") > 0) & (F.col("inside") > HEADING_PREV * (F.col("inside") + F.col("among")))).select("key")
    # those that only open pages: what the slot under the title holds, per host
    opening = labels.where((F.col("before") == OPENING) & F.col("follows")).groupBy("host", "key").agg(F.count("*").alias("n"))
    per_host = opening.groupBy("host").agg(F.sum("n").alias("all")).join(sizes, "host")
    back = F.when(((F.col("n") > 1) & (F.col("n") >= OPENING_SHARE * F.col("all"))) | (F.col("all") < OPENING_FILLED * F.col("pages")), True)
    spread = opening.join(small(cut(per_host, "slots")), "host").groupBy("key").agg(F.max(back).alias("back"), F.count("*").alias("hosts")).where(F.col("back") | (F.col("hosts") >= OPENING_HOSTS))
    only = likely.where((F.col("inside") + F.col("among")) == 0).join(spread, "key", "left_semi").select("key")
    keys = cut(inside.unionByName(only), "headings")
    return labels.join(small(keys), "key").select("row", "i")


def _long_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """row, i of the labels that are as long as text is and stand among text: paragraphs without a full stop.

    The number of words of a paragraph and of a label are taken as log-normal, as the whole corpus has them. What stands
    under the head of a box, a label that other labels follow elsewhere, is no text.
    """
    measure = [F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")]
    prose = pages.select(F.explode("prose").alias("w")).select(F.log(F.col("w")).alias("x")).agg(*measure).first()
    short = labels.where("not raw").select(F.log("words").alias("x")).agg(*measure).first()
    if not prose["n"] or not short["n"] or prose["m"] <= short["m"]:
        return labels.limit(0).select("row", "i")

    def weight(m: float, s: float) -> Column:
        s = max(s, 0.1)
        return -F.pow((F.log("words") - m) / s, F.lit(2)) / 2 - math.log(s)

    longer = F.log("words") > short["m"]
    heads = labels.groupBy(F.col("key").alias("under")).agg(F.avg(F.col("follows").cast("int")).alias("after"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("after") <= HEADING_NEXT))
    among = labels.where("raw").join(heads, "under", "left_anti")
    return among.where(longer & (weight(prose["m"], prose["s"]) > weight(short["m"], short["s"]))).select("row", "i")


def main_blocks(pages: DataFrame) -> DataFrame:
    """The blocks of the main body: page_id, pos (from 1 over all blocks of the page, blank and null ones included).

    ``pages``: page_id, url, unit, title, paragraphs; other columns are ignored. Pages without blocks or body give no
    rows. A page without url counts to the host named by its unit, or to one of its own kind without either. The same
    page under two ids, and a page_id that occurs twice, are separate pages.

    Statistics cover all pages: on how many pages of a host a node (a block with its digits masked) stands, smoothed
    for small hosts by what all other hosts show, those with one page included; between which neighbours a label stands
    in the whole corpus. Nodes are counted by hash, combined before the shuffle. A template has at most 1 / CONSTANT nodes per average block of a page,
    so it stays small and is joined to the pages by host. Every page is then handled by itself.
    """
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]+)", 1)), F.lit("")), F.concat(F.lit("unit:"), F.coalesce("unit", F.lit(""))))
    rows = pages.where("size(paragraphs) > 0").select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), clean_text(F.coalesce("title", F.lit(""))).alias("title"), "url", "paragraphs")
    keyed = cut(rows.mapInArrow(_nodes, _NODES), "pages")
    sizes = keyed.groupBy("host").agg(F.count("*").alias("pages"))
    # a node that a page has several times is as many nodes: the first, the second ...
    each = keyed.select("host", F.explode(F.arrays_zip("keys", "nth")).alias("t")).select("host", F.col("t.keys").alias("key"), "t.nth").where("nth > 0")
    once = each.groupBy("host", "key", "nth").agg(F.count("*").alias("df"))
    counted = cut(once.join(sizes, "host"), "nodes")
    overall = counted.groupBy("key", "nth").agg(F.sum("df").alias("all_df"), F.sum("pages").alias("all_pages"), F.count("*").alias("hosts")).where("all_df > 1")
    overall = cut(overall, "overall")
    nodes = counted.join(overall, ["key", "nth"])
    elsewhere = F.coalesce((F.col("all_df") - F.col("df")) / F.nullif(F.col("all_pages") - F.col("pages"), F.lit(0)), F.lit(UNKNOWN))
    share = (F.col("df") + OTHER_HOSTS * elsewhere) / (F.col("pages") + OTHER_HOSTS)
    expected = cut(nodes.where((share > CONSTANT) & ((F.col("df") > 1) | (F.col("hosts") >= ALIKE_HOSTS))).select("host", "key", "nth", "df"), "constant")
    template = cut(_templates(keyed, expected.where("df > 1").drop("df")), "templates")
    # on one page it may also be a heading that many hosts use, so only sentences are judged by it
    alike = cut(expected.where("df = 1").groupBy("host").agg(F.collect_set("key").alias("alike")), "alike")
    # the labels that lists of links of a host are made of; at most (parts of an average page) / PART_SHARE
    parted = keyed.where("size(parts) > 0").select("host", F.explode(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["keys"])))).alias("key"))
    linked = parted.groupBy("host", "key").agg(F.count("*").alias("df")).join(sizes, "host")
    linked = cut(linked.where((F.col("df") >= PART_PAGES) & (F.col("df") >= PART_SHARE * F.col("pages"))).groupBy("host").agg(F.collect_set("key").alias("known")), "parts")
    # at most (blocks of an average page) / NOTICE_SHARE nodes are on so many pages
    n_pages = keyed.count()
    spread = overall.where((F.col("nth") == 1) & (F.col("all_df") >= max(NOTICE_PAGES, NOTICE_SHARE * n_pages)) & (F.col("hosts") >= NOTICE_HOSTS))
    notices = frozenset(r["key"] for r in spread.select("key").collect())
    aligned = keyed
    for side in (template, alike, linked):
        aligned = aligned.join(small(side), "host", "left")
    judged = aligned.select("row", "page_id", "host", "blocks", "keys", "parts", "template", "title", "url", "alike", "known").mapInArrow(_classify(notices), _PAGE)
    judged = cut(judged, "kinds")
    labels = cut(judged.select("row", "host", F.explode("labels").alias("x")).select("row", "host", "x.*"), "labels")
    found = cut(_headings(labels, sizes).unionByName(_long_labels(judged, labels)).distinct(), "found")
    text = judged.select("page_id", F.explode("sure").alias("i"))
    return text.unionByName(judged.select("row", "page_id").join(found, "row").select("page_id", "i")).select("page_id", (F.col("i") + 1).cast("int").alias("pos"))
