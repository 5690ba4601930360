"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A page is a sequence of tokens: tags, told apart by their name, class and id and by the tags
around them, and text runs, told apart by their place and words. Over the pages of a host,
tokens with the same occurrence vector (how often each page has them) form a class. A class
that most pages have is valid if its tags open and close, and its runs stand, in one order and
nesting on every page that has it. The valid class that all pages have is the template's root;
a class that some pages lack is nested into it where its tokens always lie in the same gaps of
the root. The template's tokens are taken out of each page: its elements that hold links for
the most part, and its text runs, unless they stand among the article's own texts (see
``template_texts``); what remains in the article's element, or on the page where no element of
the template is one, is the main text.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.llm.common import stored

#: A class's tokens stand in at least this share of a host's pages; an article or main element is the slot if it holds this share of free text.
SUPPORT = 0.5
SLOT_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template noscript svg annotation annotation-xml iframe object canvas select title".split())
#: Their text runs to the page's end where the closing tag lacks; of other raw elements the opening tag alone is passed over then.
ENDLESS = frozenset("script style textarea noscript iframe title".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of running text: a template's run in one of them is judged by what is around it.
PROSE = frozenset("p li ul ol dl dt dd blockquote pre figcaption caption table thead tbody tfoot tr td th".split()) | HEADINGS
DROPPED = frozenset("nav header footer aside form button head menu dialog".split()) | RAW
#: Parts of class and id names of what is no article.
NOISE = frozenset(
    "ad ads advert advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended widget toolbar pagination pager".split()
)
#: Those that also name parts of articles: inside an article or main element, and of elements of running text anywhere, they mark noise only where half of the text is links.
WEAK = frozenset("header share related discussion notice alert overlay reply replies respond promo promotion menu ad ads".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)


def attributes(rest: str) -> dict[str, str]:
    if not rest or rest.isspace():
        return {}
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


def noisy(name: str, attrs: dict[str, str]) -> bool:
    """Whether the element is no part of an article, whatever is in it."""
    if name in DROPPED:
        return True
    if not attrs or name in ("body", "html", "article", "main"):
        return False
    return attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def noise_words(name: str, attrs: dict[str, str]) -> set[str]:
    """The words of the element's class and id that may mark noise; headings have none."""
    if not attrs or name in HEADINGS or name in ("body", "html", "article", "main"):
        return set()
    return set(re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) & NOISE


def wrappers(parsed: list[tuple]) -> frozenset[int]:
    """Where elements open that names call noise though they hold an article or main element, most of the
    text of a page without one, or are parts of an article (see WEAK)."""
    enclosing: dict[int, int] = {}
    weak: set[int] = set()
    size, links, total = Counter(), Counter(), 0
    holds: set[int] = set()
    semantic = False
    for kind, _, name, noise, text, (own, words, inside, link) in parsed:
        if kind in ("open", "named"):
            if words:
                enclosing[own[-1]] = own[0]
                if words <= WEAK and (inside or name in PROSE):
                    weak.add(own[-1])
            if name in ("article", "main") and not noise:
                semantic = True
                holds.add(own[0])
        elif kind == "text" and not noise:
            n = len(text.strip())
            total += n
            size[own[0]] += n
            links[own[0]] += n if link else 0
    for at in reversed(list(enclosing)):
        up = enclosing[at]
        size[up] += size[at]
        links[up] += links[at]
        if at in holds:
            holds.add(up)
    return frozenset(at for at in enclosing if at in holds or (not semantic and 2 * size[at] > total) or (at in weak and 2 * links[at] < size[at]))


def events(page: str, names: bool = True):
    """(kind, path, name, noise, text, link): 'open', 'close' or 'text' in page order; text runs are undecoded.

    path stands for the open elements, each with its class and id; noise says whether any of them,
    or the element itself, is no part of an article; link whether a text is in a link. Raw elements
    are passed over whole. Without names, class and id names mark no noise.
    """
    parsed = list(walk(page))
    marked = {-1: False}
    if names and any(words for *_, (_, words, _, _) in parsed):
        spared = wrappers(parsed)
        for *_, (own, words, _, _) in parsed:
            if words:
                marked[own[-1]] = marked[own[0]] or own[-1] not in spared
    for kind, path, name, noise, text, (own, _, _, link) in parsed:
        if kind != "named":
            yield kind, path, name, noise or marked.get(own[-1], False), text, link


def short_hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def number(token: str) -> int:
    """A token as a 64-bit number."""
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Of an open element: its path, noise, where the nearest element with noise words opens, whether it is inside an article and inside a link, and its depth.
ROOT = ("", False, -1, False, False, 0)
NOTHING = ((-1,), (), False, False)
ENDS = frozenset("p li td th tr option dt dd".split())


def walk(page: str):
    """The events, each with what wrappers needs. A path is the hash of the path around it, and its own step, so it is short at any depth."""
    stack: list[tuple] = []
    open_names: Counter[str] = Counter()
    paths: dict[tuple[str, str], str] = {}
    at, n = 0, len(page)
    state = ROOT
    while at < n:
        m = PIECE.search(page, at)
        if m is None:
            yield "text", state[0], "", state[1], page[at:], ((state[2],), (), state[3], state[4])
            break
        if m.start() > at:
            yield "text", state[0], "", state[1], page[at : m.start()], ((state[2],), (), state[3], state[4])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            if open_names[name]:
                while True:
                    top, path, noise, *_ = stack.pop()
                    open_names[top] -= 1
                    yield "close", path, top, noise, "", NOTHING
                    if top == name:
                        break
                state = stack[-1][1:] if stack else ROOT
            elif name == "p":
                yield "close", "", "p", state[1], "", NOTHING
            continue
        rest = m["rest"] or m["rest2"] or ""
        if rest.endswith("/") and (name == "svg" or name in MATH):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n if name in ENDLESS else at
            continue
        if name in VOID:
            yield "open", state[0], name, state[1], "", ((state[2],), (), state[3], state[4])
            continue
        attrs = attributes(rest)
        if name in ENDS and stack and stack[-1][0] == name:
            top, path, noise, *_ = stack.pop()
            open_names[top] -= 1
            yield "close", path, top, noise, "", NOTHING
            state = stack[-1][1:] if stack else ROOT
        if name in INLINE:
            key = state[0]
        else:
            step = name + "".join(f".{x}" for x in sorted(attrs.get("class", "").lower().split())) + (f"#{attrs['id']}" if attrs.get("id") and not re.search(r"\d", attrs["id"]) else "")
            key = paths.get((state[0], step))
            if key is None:
                key = paths[state[0], step] = f"{short_hash(state[0])}/{step}"
        words = noise_words(name, attrs)
        noise = state[1] or noisy(name, attrs)
        if words or name not in INLINE:
            own = (state[2], m.start()) if words else (state[2],)
            yield "open" if name not in INLINE else "named", key, name, noise, "", (own, words, state[3], state[4])
        state = (key, noise, m.start() if words else state[2], state[3] or name in ("article", "main"), state[4] or name == "a", state[5] + (name not in INLINE))
        stack.append((name, *state))
        open_names[name] += 1
    while stack:
        name, path, noise, *_ = stack.pop()
        yield "close", path, name, noise, "", NOTHING


def is_element(name: str) -> bool:
    return name not in VOID and name not in INLINE


def run_token(path: str, text: str) -> str:
    return f"{path}\x00{short_hash(' '.join(text.split()))}"


TOKENS = "host string, token long, path string, name string, times int, place int, depth int, chars long, links long, page long"


def page_tokens(page: str) -> dict[str, list]:
    """Of one page's tokens: path (of elements), name, times, first place, depth, and the free text and link text under each element."""
    out: dict[str, list] = {}
    under: list[list] = []  # of open elements: path, free text, link text
    for i, (kind, path, name, noise, text, link) in enumerate(events(page)):
        if kind == "open" and is_element(name):
            token = out.setdefault(path, [path, name, 0, i, len(under), 0, 0])
            token[2] += 1
            under.append([path, 0, 0])
        elif kind == "close" and path and is_element(name):
            _, chars, links = under.pop()
            out[path][5] += chars
            out[path][6] += links
            if under:
                under[-1][1] += chars
                under[-1][2] += links
        elif kind == "text" and not text.isspace():
            if not noise and under:
                under[-1][1] += len(text)
                under[-1][2] += len(text) if link else 0
            out.setdefault(run_token(path, text), ["", "", 0, i, len(under), 0, 0])[2] += 1
    return out


def tokens(pages: DataFrame) -> DataFrame:
    """One row for each page and distinct token from rows (host, mark, html)."""
    def read(batches):
        for pdf in batches:
            out = []
            for host, mark, page in zip(pdf["host"], pdf["mark"], pdf["html"], strict=True):
                out += [(host, number(token), *x, mark) for token, x in page_tokens(page).items()]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TOKENS.split(", ")])

    return pages.mapInPandas(read, TOKENS)


def classes(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The frequent classes of each host that may be of its template: a row for each token, with its class and whether that is the root.

    Occurrence vectors are compared by a sum of hashes of (page, times) over the pages, with
    their number and the sum of times. Tokens are summed up by host in each task first, so a
    host with many pages costs no more than its distinct tokens. Of a host there are no more
    frequent tokens than 1 / support times those of a page.
    """
    seen = tokens(pages).where("host is not null")
    one = F.xxhash64("page", "times").cast("decimal(38,0)")
    grouped = seen.groupBy("host", "token").agg(
        F.first("path").alias("path"), F.first("name").alias("name"), F.sum(one).alias("vector"), F.count("*").alias("pages"), F.sum("times").alias("times"),
        F.avg("place").alias("place"), F.first("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )
    counted = pages.where("host is not null").groupBy("host").agg(F.count("*").alias("all_pages"))
    grouped = grouped.where("pages > 1 or name <> ''").join(counted, "host")
    grouped = grouped.where((F.col("pages") >= support * F.col("all_pages")) & (F.col("times") == F.col("pages")))
    grouped = grouped.withColumn("class", F.xxhash64("vector", "pages")).withColumn("root", F.col("pages") == F.col("all_pages"))
    # A class of one token says nothing about the template.
    return grouped.withColumn("members", F.count("*").over(Window.partitionBy("host", "class"))).where("members > 1").drop("vector", "members", "times")


def class_orders(page: str, of: dict[int, tuple[int, bool]]) -> dict[int, int]:
    """For each class on the page a hash of how its tokens follow each other and open and close; of other classes than the root also of the root's gaps that they lie in.

    of: for each token its class and whether that is the root.
    """
    order: dict[int, list[str]] = {}
    gap = 0
    numbers: dict[str, int] = {}
    for kind, path, name, _, text, _ in events(page):
        if kind == "text":
            token = "" if text.isspace() else run_token(path, text)
        else:
            token = path if is_element(name) else ""
        if not token:
            continue
        known = numbers.get(token)
        if known is None:
            known = numbers[token] = number(token)
        if known in of:
            own, root = of[known]
            gap += root
            order.setdefault(own, []).append(f"{kind[0]}{known}" if root else f"{kind[0]}{known}@{gap}")
    return {own: number(" ".join(steps)) for own, steps in order.items()}


def templates(pages: DataFrame, support: float = SUPPORT, slot_share: float = SLOT_SHARE) -> DataFrame:
    """(host, slot, runs, menus) of each host's template: the element that encloses the article, its text runs, and its elements of links.

    A class is part of the template if all pages that have it agree on its order. The slot is an
    article or main element that holds slot_share of the free text, else the innermost element
    that holds all of it; menus are elements whose free text is in links for the most part.
    """
    marked = pages.where("host is not null")
    found = stored(classes(marked, support), "classes")
    listed = found.groupBy("host").agg(F.collect_list(F.struct("token", "class", "root")).alias("of"))

    def orders(batches):
        last, of = None, {}
        for pdf in batches:
            out = []
            for host, page, rows in zip(pdf["host"], pdf["html"], pdf["of"], strict=True):
                if host != last:
                    last, of = host, {x["token"]: (x["class"], bool(x["root"])) for x in rows}
                out += [(host, own, order) for own, order in class_orders(page, of).items()]
            yield pd.DataFrame(out, columns=["host", "class", "order"])

    agreed = marked.join(listed, "host").select("host", "html", "of").mapInPandas(orders, "host string, class long, order long")
    valid = agreed.groupBy("host", "class").agg(F.min("order").alias("low"), F.max("order").alias("high")).where("low = high").select("host", "class")
    kept = found.join(valid, ["host", "class"], "left_semi")
    most = kept.groupBy("host").agg(F.max("chars").alias("most"))
    kept = kept.join(most, "host")
    semantic = F.col("name").isin("article", "main")
    slot = (F.col("name") != "") & F.col("root") & (F.col("chars") > 0) & (F.col("chars") >= F.when(semantic, slot_share).otherwise(1.0) * F.col("most"))
    menu = (F.col("name") != "") & (F.col("chars") > 0) & (2 * F.col("links") > F.col("chars"))
    return kept.groupBy("host").agg(
        F.max_by(F.when(slot, F.col("path")), F.when(slot, F.struct(semantic, "depth", "place", "path"))).alias("slot"),
        F.collect_list(F.when(F.col("name") == "", F.col("token"))).alias("runs"), F.collect_list(F.when(menu, F.col("token"))).alias("menus"))


NONE: frozenset[int] = frozenset()


def template_texts(parsed: list[tuple], slot: str | None, runs: frozenset[int], menus: frozenset[int]) -> set[int]:
    """Places of the texts to leave out: template runs before the slot's first own text or after its last, and those of elements without any own text.

    An own text is one that isn't the template's. Between own texts a heading or a paragraph
    stays, as articles of one kind share headings; an element around them (none of PROSE)
    goes if all its text is the template's and not all of it is headings.
    """
    stack: list[list] = []  # of open elements: number among the containers or -1, whether it is the slot, a menu, a heading
    own: list[bool] = []  # of containers: whether they hold an own text
    prose: list[bool] = []  # and a template run that is no heading
    texts: list[tuple[int, bool, tuple[int, ...]]] = []
    inside = skipped = headings = 0
    for i, (kind, path, name, noise, text, _) in enumerate(parsed):
        if kind == "text":
            if noise or skipped or text.isspace() or not (inside or slot is None):
                continue
            around = tuple(x[0] for x in stack if x[0] >= 0)
            template = number(run_token(path, text)) in runs
            for c in around:
                if not template:
                    own[c] = True
                elif not headings:
                    prose[c] = True
            texts.append((i, template, around))
        elif path and is_element(name):
            if kind == "open":
                container = -1
                if name not in PROSE and path != slot:
                    container = len(own)
                    own.append(False)
                    prose.append(False)
                at_slot, menu, heading = path == slot and not noise, path != slot and number(path) in menus, name in HEADINGS
                stack.append([container, at_slot, menu, heading])
                inside, skipped, headings = inside + at_slot, skipped + menu, headings + heading
            else:
                _, at_slot, menu, heading = stack.pop()
                inside, skipped, headings = inside - at_slot, skipped - menu, headings - heading
    mine = [i for i, template, _ in texts if not template]
    first, last = (mine[0], mine[-1]) if mine else (len(parsed), -1)

    def goes(i: int, around: tuple[int, ...]) -> bool:
        whole = next((c for c in around if not own[c]), None)
        return not first < i < last or (whole is not None and prose[whole])

    return {i for i, template, around in texts if template and goes(i, around)}


def blocks(page: str, slot: str | None, marks: bool = True, runs: frozenset[int] = NONE, menus: frozenset[int] = NONE) -> tuple[list[str], int]:
    """The text blocks inside the slot's element, or of the whole page without one, and how much text of them the template's runs and menus took."""
    out: list[str] = []
    run: list[str] = []
    inside = skipped = taken = 0
    found = False
    numbers: dict[str, bool] = {}

    def is_menu(path: str) -> bool:
        if path not in numbers:
            numbers[path] = path != slot and number(path) in menus
        return numbers[path]

    def flush() -> None:
        words = " ".join(html_lib.unescape("".join(run)).split())
        if words:
            out.append(words)
        run.clear()

    parsed = list(events(page, marks))
    leave_out = template_texts(parsed, slot, runs, menus) if runs else ()
    for i, (kind, path, name, noise, text, _) in enumerate(parsed):
        element = kind != "text" and bool(path) and is_element(name)
        if element and menus and is_menu(path):
            skipped += 1 if kind == "open" else -1
        if slot is not None and kind == "open" and path == slot and element and not noise:
            inside, found = inside + 1, True
            flush()
        elif slot is not None and kind == "close" and path == slot and element and inside:
            flush()
            inside -= 1
        elif inside or slot is None:
            if kind == "text":
                if not noise:
                    if skipped or i in leave_out:
                        taken += len(text)
                    else:
                        run.append(text)
            elif name not in INLINE:
                if name in VOID:
                    if name in ("br", "hr"):
                        run.append(" ")
                else:
                    flush()
    flush()
    return (out, taken) if found or slot is None else ([], 0)


def main_text(page: str, slot: str | None, runs: frozenset[int] = NONE, menus: frozenset[int] = NONE) -> str:
    """The article's text: blocks in page order joined by one space.

    Where the page lacks the host's slot, or the host has none: the page's article or main
    element with most text, else all of the page that isn't marked as something else, or marked
    by names alone. A page of which the template's text would be more than half is itself
    what the host's pages copy, and keeps it.
    """
    def read(where: str | None) -> list[str]:
        found, taken = blocks(page, where, True, runs, menus)
        return blocks(page, where)[0] if taken > sum(map(len, found)) else found

    found = read(slot) if slot else []
    if not found:
        own = [(x[5], path) for path, x in page_tokens(page).items() if x[1] in ("article", "main") and x[5]]
        found = read(max(own)[1] if own else None)
    if not found:
        # Names alone never empty a page.
        found = blocks(page, None, marks=False)[0]
    return " ".join(found)


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def extract_main_text(pages: DataFrame, support: float = SUPPORT, slot_share: float = SLOT_SHARE) -> DataFrame:
    """For each page: page_id, url, text, n_chars.

    Takes columns page_id, url and html; others are ignored, whatever their names. A null or
    empty html has an empty text; a null url or one without host belongs to no host and is read
    by the page's own elements alone. White space around and inside blocks is one space;
    character references are decoded once. Repeated rows each give a row; an empty table none.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    marked = rows.select("host", F.xxhash64("page_id", "url").alias("mark"), "html")
    # One row for each host, of no more tokens than a page has; a join, as hosts may be many. A hot host's rows need no common task.
    known = stored(templates(marked, support, slot_share), "templates")
    joined = rows.join(known, "host", "left")

    def extract(batches):
        for pdf in batches:
            text = []
            for page, slot, runs, menus in zip(pdf["html"], pdf["slot"], pdf["runs"], pdf["menus"], strict=True):
                sets = (frozenset(x) if x is not None else NONE for x in (runs, menus))
                text.append(main_text(page, slot if isinstance(slot, str) else None, *sets))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "slot", "runs", "menus").mapInPandas(extract, f"page_id {kind}, url string, text string, n_chars long")
