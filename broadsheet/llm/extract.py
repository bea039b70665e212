"""Main text of HTML pages: the maximum-scoring contiguous run of a page's words and tags.

A page is read as a sequence of text runs and tags. A word scores WORD. A tag costs what labelled pages say: SCALE times the logarithm of how much
oftener it stands outside of the main text than inside, between LEAST_COST and MOST_COST. One pass (Kadane) finds the run with the highest
sum, and that run is the main text: nothing widens or narrows it afterwards. What the names, roles, classes and styles of elements say goes into the weights: a
tag inside of an element that looks like a menu, header, footer, sidebar, notice, advert, form or comment is a tag of another kind ("li!" besides
"li"), and a text there is counted like a tag (ASIDE_TEXT). What is inside of an article or main element is of a third kind ("li@", ASIDE_TEXT + "@"),
which costs the least unless pages say otherwise, so an advert there does not end the run; the article and main tags themselves are of the first. Such texts inside of the run are left out of it, as are scripts and styles.

Labelled pages are pages with one article or main element that is no comment, whose inside is the label; at most MAX_PAGES of them, chosen by a hash of
the page, are counted, and the driver gets one count per tag name (the MAX_TAGS most frequent ones; others cost 1). Without labelled pages every block tag costs 1.
On pages that have no such element at all, tags that nothing tells from others have the cost of their plain name ("li?"), which counts all of them.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by an empty line in page order.
Defined results: null and empty pages, and pages without words outside of the parts left out, have the empty text. An unclosed
comment, script or style hides the rest of the page; an unfinished tag at the end is dropped. Repeated rows each have their text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORD = 1.0
SCALE = 4.0
LEAST_COST, MOST_COST = 0.02, 50.0
#: What the names of tags and of ASIDE_TEXT may end in, see above.
KINDS = "!@?"
#: Name under which a text in an element that is none of the main text has its cost.
ASIDE_TEXT = "!"
MAX_PAGES = 4_000
MAX_TAGS = 1_500

# Fixed values of HTML: elements whose content is not markup, and elements that begin a block.
RAW = frozenset("script style noscript template iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
SPACE = frozenset("br td th wbr img input".split()) - {"wbr"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog button select head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names that page authors give to what is not the main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner banners promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus respond replies reply sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended newsletter subscribe subscription signup login search searchbox pagination pager paging toolbar widget widgets copyright disclaimer".split()
)
MAIN_NAMES = frozenset("content article main post entry story text body".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.DOTALL)
_attribute = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden").search


def is_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is none of the main text, by its name, role, class, id or style."""
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _hidden(found.get("style", "").lower()) or found.get("role", "").lower() in ROLES:
        return True
    names = [re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower() for n in f"{found.get('class', '')} {found.get('id', '')}".split()]
    if any(n in MAIN_NAMES for n in names):
        return False
    for n in names:
        bits = [b for b in re.split("[^a-z0-9]+", n) if b]
        if bits and bits[0] not in ("has", "with", "no") and (bits[-1].rstrip("0123456789") in NAMES or bits[0] in NAMES or bits[-1] == "header" and not in_article):
            return True
    return False


def items(page: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    """([(tag, None) or (None, text) or, for text left out, (ASIDE_TEXT or that and "@", text)], [(first, last) item of each article or main element]); tags end in their kind."""
    out: list[tuple] = []
    spans, opened = [], []
    at, aside, depth = 0, "", 0
    n = len(page)

    def named(tag: str) -> str:
        if tag in ("article", "main"):
            return tag
        return f"{tag}@" if opened else f"{tag}!" if aside and tag != ASIDE_TEXT else tag

    while at < n:
        m = _token.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            out.append((named(ASIDE_TEXT) if aside else None, entities.unescape(text)))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            kind = named(tag)
            if aside and tag == aside:
                depth -= 1
                if not depth:
                    aside = ""
            elif tag in ("article", "main") and opened and not aside:
                spans.append((opened.pop(), len(out)))
            out.append((kind, None))
            continue
        closed = m[3].endswith("/") or tag in VOID
        if aside and not closed and tag in ("article", "main") and not is_aside(tag, m[3], True) and aside not in ("article", "div", "section", "li", "ul", "ol"):
            aside = ""
        if aside:
            depth += tag == aside and not closed
        elif not closed and is_aside(tag, m[3], bool(opened)):
            aside, depth = tag, 1
        elif tag in ("article", "main") and not closed:
            opened.append(len(out))
        out.append((named(tag), None))
        if tag in RAW and not closed:
            end = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            if aside == tag:
                aside = ""
    spans += [(first, len(out)) for first in opened]
    return out, spans


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the highest sum, the earliest and longest of equals; (0, 0) if none is positive."""
    best, run, low, high, start = 0.0, 0.0, 0, 0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or run == best and best and start == low:
            best, low, high = run, start, i + 1
    return low, high


def blocks(found: list[tuple]) -> list[str]:
    out, part = [], []
    for tag, text in found:
        if tag is None:
            part.append(text)
        elif tag.rstrip(KINDS) in BLOCK and part:
            out.append("".join(part))
            part = []
        elif tag.rstrip(KINDS) in SPACE:
            part.append(" ")
    return [b for b in (" ".join(x.split()) for x in [*out, "".join(part)]) if b]


def main_text(page: str | None, costs: dict[str, float], default: float) -> str:
    found, spans = items(page or "")
    kinds = [tag if tag is None or spans or tag.endswith("!") else f"{tag}?" for tag, _ in found]

    def cost(kind: str) -> float:
        return costs.get(kind, LEAST_COST if kind.endswith("@") else default)

    low, high = best_run([WORD * len(text.split()) if kind is None else -cost(kind) for kind, (_, text) in zip(kinds, found)])
    return "\n\n".join(blocks(found[low:high]))


def learn(pages: DataFrame, html: str = "html", max_pages: int = MAX_PAGES) -> tuple[dict[str, float], float]:
    """(cost of each tag, cost of other tags) from pages that one article or main element labels."""
    common.bound_batches(pages.sparkSession)
    some = pages.select(F.col(html).alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = some.count()
    if n > max_pages:
        some = some.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(max_pages / n * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                found, spans = items(page.as_py())
                if len(spans) == 1:
                    first, end = spans[0]
                    for i, (tag, _) in enumerate(found):
                        if tag is not None:
                            for kind in {tag, f"{tag.rstrip(KINDS)}?"}:
                                (inner if first < i < end else outer)[kind] += 1
        names = sorted({*inner, *outer})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inner[t] for t in names], pa.int64()), pa.array([outer[t] for t in names], pa.int64())], names=["tag", "inside", "outside"])

    totals = some.mapInArrow(count, "tag string, inside bigint, outside bigint").groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = totals.orderBy(F.desc(F.col("inside") + F.col("outside")), "tag").limit(MAX_TAGS).collect()
    if not rows:
        return dict.fromkeys([ASIDE_TEXT, *(f"{t}{kind}" for t in BLOCK for kind in ("", "!", "?"))], 1.0), LEAST_COST
    costs = {r.tag: min(MOST_COST, max(LEAST_COST, SCALE * math.log2((r.outside + 0.5) / (r.inside + 0.5)))) for r in rows}
    return costs, 1.0


def extract(pages: DataFrame, costs: dict[str, float], default: float, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds string `out` with the main text of each whole page."""
    common.bound_batches(pages.sparkSession)
    keep = pages.columns if keep is None else keep
    common.check_new(pages.select(*keep), out)
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(p.as_py(), costs, default) for p in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(made, pa.string())], names=schema.names)

    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, *learn(pages), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
