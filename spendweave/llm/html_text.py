"""Main text of web pages by consensus paths of each host."""
from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

# Element names of HTML by their role here, and names in class, id and role that mark page furniture.
CONTAINERS = frozenset("body article main section div td table ul ol dl figure blockquote header center details fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li hr tr th dt dd pre caption figcaption summary address legend html head".split())
LEFT_OUT = frozenset("title nav aside footer form button select option iframe object svg canvas noscript template audio video dialog map".split())
RAW = frozenset("script style textarea xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OPTIONAL_END = frozenset("p li dt dd tr th td option".split())
FURNITURE = frozenset((
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login search social share sharing related recommended recommendations comment comments "
    "disqus respond reply replies widget widgets copyright complementary contentinfo").split())
# of these, names that say less about an element when they only qualify another word (notice-board, search-history), and words of layout
QUALIFIERS = frozenset("notice notices alert search".split())
LAYOUT = frozenset("area bar block box button container content form icon inner input item list message outer panel row site text top wrap wrapper".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""", re.S)
NAMING = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HALF = 0.75        # what a container gets of the score of one inside it
SHARE = 0.1        # part of a host's votes from which a path is one of its winners


@dataclass
class Page:
    """Containers as (parent, path), blocks as (container, text, characters in links), both in page order."""
    containers: list[tuple[int, str]] = field(default_factory=lambda: [(-1, "")])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _names(attributes: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in NAMING.findall(attributes)} if attributes else {}


def _marks_furniture(name: str) -> bool:
    """One class, id or role, by its parts. A qualifier counts where it is the last part, or where only words of layout stand beside it."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if p]
    found = FURNITURE.intersection(parts)
    if found - QUALIFIERS:
        return True
    return bool(found) and (parts[-1] in QUALIFIERS or all(p in QUALIFIERS or p in LAYOUT for p in parts))


def _is_furniture(names: dict[str, str]) -> bool:
    return any(_marks_furniture(name) for v in names.values() for name in v.split())


def _step(tag: str, names: dict[str, str]) -> str:
    """Tag and classes, generalised: digits and what follows them in a class name differ from page to page."""
    classes = sorted({re.split(r"\d", c)[0].strip("-_") for c in names.get("class", "").lower().split()} - {""})
    return ".".join([tag, *classes])


def parse(source: str) -> Page:
    """Blocks outside page furniture, each with the container it lies in. Missing end tags are taken as browsers take them, as far
    as containers go: an end tag closes what is open inside its element, one without a start is passed over."""
    page = Page()
    open_tags: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    link_pieces = 0
    in_link = 0
    skip_tag, skip_depth, inside = "", 0, {}
    skip_block = False

    def flush():
        nonlocal link_pieces, skip_block
        if pieces:
            text = " ".join(html_module.unescape("".join(pieces)).split())
            if text and not skip_block:
                page.blocks.append((open_tags[-1][1], text, min(len(text), link_pieces)))
            pieces.clear()
        link_pieces, skip_block = 0, False

    at, end_of = 0, len(source)
    while at < end_of:
        found = TAG.search(source, at)
        stop = found.start() if found else end_of
        if stop > at and not skip_tag:
            pieces.append(source[at:stop])
            link_pieces += (stop - at) * (in_link > 0)
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            close = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
            after = source.find(">", close.start()) if close else -1
            at = end_of if after < 0 else after + 1
            continue
        if skip_tag:
            if closing:
                if tag == skip_tag:
                    skip_depth -= 1
                    if skip_depth == 0:
                        skip_tag = ""
                    continue
                if inside.get(tag):
                    inside[tag] -= 1
                    continue
                if all(name != tag for name, _ in open_tags):
                    continue
                skip_tag = ""            # an element around it ends: it was never closed
            else:
                if tag == skip_tag:
                    skip_depth += 1
                elif tag in CONTAINERS:
                    inside[tag] = inside.get(tag, 0) + 1
                continue
        if closing:
            in_link = max(0, in_link - 1) if tag == "a" else in_link
            if tag in BLOCKS:
                flush()
                in_link = 0
            if tag in CONTAINERS and any(name == tag for name, _ in open_tags):
                while open_tags.pop()[0] != tag:
                    pass
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        names = _names(attributes)
        article = any(name in ("article", "main") for name, _ in open_tags)
        if tag not in ("html", "body", "article", "main") and (
                tag in LEFT_OUT or (tag == "header" and not article) or _is_furniture(names)) and not attributes.endswith("/"):
            if tag in OPTIONAL_END:
                skip_block = True
            elif tag not in VOID:
                skip_tag, skip_depth, inside = tag, 1, {}
            continue
        if tag == "a":
            in_link += 1
        if tag in CONTAINERS:
            if tag == "td":
                while open_tags[-1][0] == "td":
                    open_tags.pop()
            parent = open_tags[-1][1]
            above = page.containers[parent][1]
            page.containers.append((parent, f"{above}>{_step(tag, names)}" if above else _step(tag, names)))
            open_tags.append((tag, len(page.containers) - 1))
    flush()
    return page


def container_scores(page: Page) -> list[float]:
    """Characters outside links; most of a container's score goes on to the one around it, so the container that gathers the
    text wins over one of its parts and over the page."""
    scores = [0.0] * len(page.containers)
    for container, text, linked in page.blocks:
        scores[container] += len(text) - linked if _is_prose(text, linked) else 0.0
    for i in range(len(scores) - 1, 0, -1):
        parent = page.containers[i][0]
        scores[parent] += HALF * scores[i]
    return scores


def _is_prose(text: str, linked: int) -> bool:
    return linked < 0.5 * len(text)


def lifted(page: Page, at: int) -> int:
    """The container to return for a winner: the nearest article or main around it, and from there (or from the winner, where there is
    none) upwards below the body as long as the container around has text of its own, such as a heading or a lead."""
    own = {container for container, text, linked in page.blocks if _is_prose(text, linked)}
    tag = lambda i: re.split(r"[.>]", page.containers[i][1].rsplit(">", 1)[-1])[0]
    up = at
    while up > 0 and tag(up) not in ("article", "main"):
        up = page.containers[up][0]
    at = up if up > 0 else at
    while (parent := page.containers[at][0]) > 0 and tag(parent) != "body" and parent in own:
        at = parent
    return at


def best_container(page: Page) -> tuple[str, float]:
    scores = container_scores(page)
    top = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return page.containers[lifted(page, top)][1], scores[top]


def text_under(page: Page, path: str) -> str:
    wanted = [False] * len(page.containers)
    for i, (parent, own) in enumerate(page.containers):
        wanted[i] = own == path or (i > 0 and wanted[parent])
    return "\n".join(text for container, text, _ in page.blocks if wanted[container])


def extract(source: str | None, paths: list[str] | None, shares: list[float] | None = None) -> str:
    """Text under one of the host's paths, else under the page's own best container.

    A host may have several templates, and a small box may lie where another template has its article. So of the host's paths
    that have text here, the one with the largest score on this page times the square of its share of the host's votes counts;
    of equal ones, such as those without prose, the first.
    """
    page = parse(source or "")
    if paths:
        scores: dict[str, float] = {}
        for (_, path), score in zip(page.containers, container_scores(page)):
            scores[path] = max(score, scores.get(path, 0.0))
        weights = shares or [1.0] * len(paths)
        here = sorted((-scores[path] * weight ** 2, i) for i, (path, weight) in enumerate(zip(paths, weights)) if path in scores)
        for _, i in here:
            if text := text_under(page, paths[i]):
                return text
    return text_under(page, best_container(page)[0])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """Winning paths of each host and their shares of its votes: (host, paths, shares). Each page votes for the path of its best container; votes are counted by
    (host, path), pre-aggregated, and paths with a tenth of a host's votes or more win, most votes first (ties: more text, then
    by name). So a host has ten paths at most."""
    schema = "host string, path string, score double"

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [(host.as_py(), *best_container(parse(source.as_py() or ""))) for host, source in zip(batch.column(0), batch.column(1))]
            votes = [v for v in votes if v[2] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in votes], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))],
                                             names=["host", "path", "score"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, schema)
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    shared = counted.withColumn("of", F.sum("votes").over(W.partitionBy("host"))).where(F.col("votes") >= SHARE * F.col("of"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.round("score")).alias("s"), "path",
                                                       (F.col("votes") / F.col("of")).alias("share"))))
    return shared.groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("paths"), F.col("r.share").alias("shares"))


def main_texts(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of every page: ``carry``, text, n_chars.

    Pages are read twice, first to vote, then to extract with the paths that won. Winners are a small stage table, so the join
    is by broadcast as long as its size allows and by host beyond, where the rows of a large host are split. Null or empty html
    gives an empty text; pages without a usable url vote together as one host; a page without the host's paths uses its own
    best container. Repeated rows are extracted each, an empty table gives an empty result, other columns are ignored.
    """
    carry = list(carry)
    winners = stage(host_paths(pages), "html-paths")
    wanted = pages.select(*carry, host_of(F.col("url")).alias("_host"), F.col("html").alias("_html"))
    joined = wanted.join(winners, F.col("_host") == F.col("host"), "left").select(*carry, "_html", F.col("paths").alias("_paths"), F.col("shares").alias("_shares"))
    schema = T.StructType([*[pages.schema[c] for c in carry], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts = [extract(*(v.as_py() for v in row)) for row in zip(*(batch.column(c) for c in ("_html", "_paths", "_shares")))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(texts, pa.string()),
                                                  pa.array(map(len, texts), pa.int64())], names=[f.name for f in schema])

    return joined.mapInArrow(run, schema)


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
