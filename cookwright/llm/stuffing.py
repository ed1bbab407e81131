"""Keyword-stuffed pages, link lists and product tags, told from prose, recipes and glossaries.

Each page is split into segments. Sentences and stated ingredients are content; what has the density of a list (links,
hash tags, article numbers, separators, words without function words) and short phrases that are neither are open to
doubt. Their phrase shingles, five words long and two words long, are exploded, and the hosts that use each phrase are
counted over all texts. Words count as stuffing where both kinds of evidence meet: they stand in phrases that other
hosts or the page itself use again and again, and outside content. A page is flagged when that is more than half of
its words. In shingles a link, a hash tag and a number are each one word, whatever they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cookwright.operators.quantities import parse_amounts
from cookwright.plans.frames import spread, stored

#: Words of a phrase that is replicated if hosts use it, and of one whose words have to be associated besides.
PHRASE, SHORT = 5, 2
#: Hosts that have to use a phrase, and places of one page that count as replication of their own.
HOSTS, REPEATS = 3, 3
#: Normalised pointwise mutual information of a short phrase's words over hosts from which it counts as replicated: 0
#: where as many hosts use the phrase as would by chance, 1 where its words stand only in it, whatever the number of hosts.
ASSOCIATION = 0.5
#: Share of stuffing above which a page is flagged.
SHARE = 0.5
#: Share of function words that makes words between full stops a sentence.
FUNCTION_SHARE = 0.12
#: Share of function words that makes a whole line prose.
PROSE_SHARE = 0.25
#: Bits of the filter that keeps phrases of no doubtful page from leaving the scan of all texts; hits are joined exactly.
FILTER_BITS = 1 << 26

# Function words that sentences have and lists of keywords don't.
FUNCTION_WORDS = frozenset(
    "the a an and or but if so as at by for from of on that this these those it its is are was were be been has have had i we you they he she my your our their them there here not no never who which what when while where than then too very just only also into over until before after through without will would can could should do does did once more most some any such like between away"
    " och att det den de som en ett på är var av för med inte till om men så när jag du vi han hon ni sig sin sitt har hade kan ska vill blir blev efter före utan över under mot vid från där här alla allt något också bara mycket lite viss mer ut upp"
    " el la los las un una unos unas y o que es son está están fue era no se lo le su sus mi con sin por para pero como más muy ya si al del en este esta cuando donde hasta desde sobre antes después también puede hay todo toda nadie tan"
    " der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war waren wird werden hat haben ich du er sie wir ihr es man sich mit ohne für von zu zum zur auf aus bei bis nach vor über unter wenn als wie dass auch noch nur sehr so am im an beim etwas alles viel".split()
) - frozenset("i in no".split())

_WORD = re.compile(r"\w+(?:['’]\w+)?")
_TOKEN = re.compile(r"#\w+|\x00|\w+(?:['’]\w+)?")
_URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/\S*|\b[\w-]+\.(?:example|com|net|org|info|biz|io|shop|de|se|es|co|uk)\b\S*", re.I)
_ANCHOR = re.compile(r"<a\s[^>]*>.*?</a>|\[url[^\]]*\].*?\[/url\]|\[[^\]\n]+\]\([^)\s]+\)", re.I | re.S)
_MARKUP = re.compile(r"<a\s|\[url|\]\(", re.I)
_DOTTED = re.compile(r"\.[^\W\d]")
_NUMBERED = re.compile(r"\d{3}|\d[.,]\d\d|[€$£]")
_TAG = re.compile(r"#\w+")
_CODE = re.compile(r"\b(?:EAN|SKU|REF|ISBN|GTIN|UPC|ASIN|MPN|No|Nr|Art|Item)\b\.?:?\s*#?\d{3,}|(?:\b\d+[.,]\d\d\s?(?:EUR|USD|SEK|GBP|kr)\b|[€$£]\s?\d+[.,]\d\d|\d+[.,]\d\d\s?[€$£])", re.I)
_SEPARATOR = re.compile(r"\s[|·•>»/*~–-]\s|[;|•·»]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+")
_BULLET = re.compile(r"^\s*(?:[-*•–]|\d{1,2}[.)])\s+")
_COUNTED = re.compile(r"^\d[\d\s/.,½¼¾⅓⅔–-]*\s*[^\W\d]")
_MENU = re.compile(r"^[^\d]{1,40}\(\d+\)$")
_CAMEL = re.compile(r"[a-zà-ÿ\d][A-ZÀ-Þ]")
_CAMEL_WORD = re.compile(r"\w*[a-zà-ÿ\d][A-ZÀ-Þ]\w*")

_ENDS = ".!?…\"”’)"
LIST, OPEN, CONTENT = 2, 1, 0
_functions = FUNCTION_WORDS.__contains__


def _is_sentence(words: list[str]) -> bool:
    n = len(words)
    return n >= 3 and sum(map(_functions, words)) >= max(1, FUNCTION_SHARE * n)


def _sentences(body: str) -> list[tuple[int, int, str]]:
    """The pieces of a line between full stops: kind, words, text."""
    out = []
    for piece in _SENTENCE.split(body):
        words = _WORD.findall(piece.lower())
        if words:
            kind = CONTENT if _is_sentence(words) else LIST if len(words) >= 3 and piece[-1:] in ".!?…" else OPEN
            out.append((kind, len(words), piece))
    return out


def without_links(text: str) -> tuple[str, int, int]:
    """The text with each link as one sign; the links, and the words in their addresses and anchors."""
    links = words = 0
    for pattern, some in ((_ANCHOR, ("<" in text or "[" in text) and _MARKUP.search(text)), (_URL, "://" in text or _DOTTED.search(text))):
        if some:
            found = pattern.findall(text)
            if found:
                links += len(found)
                words += sum(len(_WORD.findall(m)) for m in found)
                text = pattern.sub(" \x00 ", text)
    return text, links, words


def segments(text: str) -> tuple[int, float, list[tuple[int, float, str]]]:
    """Words of the page, words of one of its links, and its segments in order: kind, words and text, in which links
    are single signs."""
    text, links, linked = without_links(text)
    per_link = linked / links if links else 0.0
    total, out = 0.0, []
    for line in text.split("\n"):
        n_links = line.count("\x00")
        plain = line.replace("\x00", " ").strip() if n_links else line.strip()
        words = _WORD.findall(plain.lower())
        n = len(words)
        if not n and not n_links:
            continue
        total += n + n_links * per_link
        if not n:
            out.append((LIST, n_links * per_link, line))
            continue
        functions = sum(map(_functions, words))
        if n >= 8 and not n_links and functions >= PROSE_SHARE * n and plain[-1] in _ENDS and "#" not in plain:
            out.append((CONTENT, n, line))
            continue
        body = _BULLET.sub("", plain)
        spoken = n >= 3 and functions >= max(1, FUNCTION_SHARE * n)
        parts = None
        if n_links and n <= 6 * n_links and not spoken:
            kind = LIST  # the labels of links
        elif ("#" in plain and 2 * len(_TAG.findall(plain)) >= n) or (n >= 3 and len(plain) >= 8 * n and _CAMEL.search(plain) and 2 * len(_CAMEL_WORD.findall(plain)) >= n) or (_NUMBERED.search(plain) and _CODE.search(plain)) or _MENU.match(body):
            kind = LIST
        elif (cuts := len(_SEPARATOR.findall(body))) >= 3 and n <= 7 * (cuts + 1) and not (spoken and plain[-1] in ".!?…"):
            kind = LIST
        elif plain[-1] in _ENDS and body and not _COUNTED.match(body):
            kind, parts = OPEN, _sentences(body)
        elif n <= 16 and (_COUNTED.match(body) or parse_amounts(body)):
            kind = CONTENT  # an ingredient
        elif n > 8 and spoken and functions >= PROSE_SHARE * n and body.count(",") * 6 < n:
            kind = CONTENT  # prose without a full stop
        elif n > 12:
            # a long line: prose broken off in it is content, the rest are heaps
            kind, parts = LIST, [(CONTENT if k == CONTENT and t[-1:] in ".!?…" else LIST, m, t) for k, m, t in _sentences(body)]
        else:
            kind = OPEN
        if parts is None:
            out.append((kind, n + (n_links * per_link if kind == LIST else 0.0), line))
        else:
            out += parts
        if n_links and (parts is not None or kind != LIST):
            out.append((LIST, n_links * per_link, "\x00 " * n_links))  # links amid other text
    return round(total), per_link, out


class _Hashes(dict):
    """Hash of a word as it stands in shingles: hash tags are all alike, and so are numbers, with a unit or without."""

    def __missing__(self, word: str) -> int:
        plain = "#" if word[0] == "#" or _CAMEL.search(word) else "0" if word[0].isdigit() else word.lower()
        self[word] = xxhash.xxh64_intdigest(plain)
        return self[word]


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, PHRASE + 1)], dtype=np.uint64)


def _shingled(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            x = h[k : k + n] * _FACTORS[k]
            out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


_LINK, _HASH_TAG = xxhash.xxh64_intdigest("\x00"), xxhash.xxh64_intdigest("#")
_LINK, _HASH_TAG = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("\x00", "#"))
_DDL = "page long, doc long, host string, words int, doubtful double, link double, tokens array<long>, lines array<int>, runs array<int>, phrases array<struct<p: long, a: long, b: long>>"
_PHRASE = pa.struct([("p", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _doubtful_words(found: list[tuple[int, float, str]], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words outside content as hashes, with the number of their line, and of their run: lines of lists that follow
    one another are one run. Runs that are no lists have negative numbers."""
    tokens, lines, runs = [], [], []
    last, run = CONTENT, 0
    for k, (kind, _n, text) in enumerate(found):
        if kind != CONTENT:
            mine = [hashes[w] for w in _TOKEN.findall(text)]
            run += not (kind == LIST and last == LIST)
            tokens += mine
            lines += [k] * len(mine)
            runs += [run if kind == LIST else -run] * len(mine)
        last = kind
    return np.array(tokens, dtype=np.uint64), np.array(lines, dtype=np.int32), np.array(runs, dtype=np.int32)


def _phrases(h: np.ndarray, lines: np.ndarray, runs: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of phrase the places where one begins, and its hash there: long ones lie within a run, short ones
    within a line; a line of a single word is a phrase of its own, and so is every word of a list."""
    out = []
    for size, within in ((PHRASE, runs), (SHORT, lines)):
        g = _shingled(h, size)
        at = np.flatnonzero(within[: len(g)] == within[size - 1 :][: len(g)])
        out.append((size, at, g[at]))
    before = np.concatenate([[True], lines[1:] != lines[:-1]]) if len(lines) else np.zeros(0, dtype=bool)
    alone = np.flatnonzero((runs > 0) | before & np.concatenate([before[1:], [True]])) if len(lines) else np.zeros(0, dtype=np.int64)
    return [*out, (1, alone, h[alone])]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
    hashes, none = _Hashes(), (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))
    for batch in batches:
        rows, words, asked = [], [], []
        if len(hashes) > 500_000:
            hashes.clear()
        for doc, host, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not text:
                continue
            total, per_link, found = segments(text)
            if not total:
                continue
            doubtful = sum(n for kind, n, _ in found if kind != CONTENT)
            own, pairs = none, (none[0], none[0], none[0], np.zeros(0, dtype=bool))
            if doubtful > SHARE * total:  # content is no stuffing however often it is repeated, so others can't be flagged
                own = h, _, _ = _doubtful_words(found, hashes)
                (_, _, long), (_, at, short), _ = _phrases(*own)
                long, (short, first) = np.unique(long), np.unique(short, return_index=True)
                at = at[first]
                pairs = (np.concatenate([long, short]), np.concatenate([long, h[at]]), np.concatenate([long, h[at + 1]]), np.arange(len(long) + len(short)) < len(long))
            rows.append((xxhash.xxh64_intdigest(f"{doc}:{host}:{text}") >> 1, doc, host, total, float(doubtful), per_link))
            words.append(own)
            asked.append(pairs)
        if rows:
            p, a, b, long = (np.concatenate(x) for x in zip(*asked))
            ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in asked])]).astype(np.int32)
            phrases = pa.StructArray.from_arrays([pa.array(_signed(p)), pa.array(_signed(a), mask=long), pa.array(_signed(b), mask=long)], fields=list(_PHRASE))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            columns += [_lists([_signed(x[0]) for x in words], pa.int64()), _lists([x[1] for x in words], pa.int32()), _lists([x[2] for x in words], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), phrases)]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "doc", "host", "words", "doubtful", "link", "tokens", "lines", "runs", "phrases"])


def _covered(h: np.ndarray, lines: np.ndarray, runs: np.ndarray, replicated: np.ndarray, per_link: float) -> tuple[float, float, float]:
    """Words in phrases that the page itself repeats, in phrases that other hosts use, and in either; links and hash tags
    are no prose in any case."""
    phrases = _phrases(h, lines, runs)
    u, n = np.unique(np.concatenate([g for _, _, g in phrases]), return_counts=True)
    repeated = u[n >= REPEATS]
    weight = np.where(h == _LINK, per_link, 1.0)
    hits = []
    for known in (repeated, replicated):
        hit = (h == _LINK) | (h == _HASH_TAG)
        for size, at, g in phrases:
            starts = at[np.isin(g, known)]
            for d in range(size):
                hit[starts + d] = True
        hits.append(hit)
    return tuple(float(weight[hit].sum()) for hit in (*hits, hits[0] | hits[1]))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        lists = [[np.asarray(x.values) for x in batch.column(c)] for c in ("tokens", "lines", "runs")]
        for doc, per_link, hits, h, lines, runs in zip(batch.column("doc").to_pylist(), batch.column("link").to_pylist(), batch.column("hits").to_pylist(), *lists):
            out.append((doc, *_covered(h.astype(np.int64).view(np.uint64), lines, runs, np.array(hits or (), dtype=np.int64).view(np.uint64), per_link)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc", "own", "others", "w"])


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)


#: Words whose shingles are made at once.
_AT_ONCE = 1_000_000


def _shingles(shared):
    """``host, grams``: of every text the distinct words and phrases of both lengths, whatever its lines are, that pass
    the filter."""

    def passing(hosts: list, words: list[int], sizes: list[int], bitmap: np.ndarray) -> pa.RecordBatch:
        h, text = np.array(words, dtype=np.uint64), np.repeat(np.arange(len(sizes)), sizes)
        owners, grams = [], []
        for size in (1, SHORT, PHRASE):
            g = h if size == 1 else _shingled(h, size)
            bits = _bits(g)
            at = np.flatnonzero((bitmap[bits >> 3] >> (bits & 7)) & 1)
            at = at[text[at] == text[at + size - 1]]  # not over the end of a text
            owners.append(text[at])
            grams.append(g[at])
        owner, gram = np.concatenate(owners), np.concatenate(grams)
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
        owner, gram = owner[new], gram[new]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(gram)))], names=["host", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, known = shared.value, _Hashes()
        for batch in batches:
            hosts, words, sizes = [], [], []
            if len(known) > 500_000:
                known.clear()
            for host, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    mine = [known[w] for w in _TOKEN.findall(without_links(text)[0])]
                    hosts.append(host)
                    words += mine
                    sizes.append(len(mine))
                    if len(words) > _AT_ONCE:
                        yield passing(hosts, words, sizes, bitmap)
                        hosts, words, sizes = [], [], []
            if hosts:
                yield passing(hosts, words, sizes, bitmap)

    return run


def _filter(wanted: DataFrame) -> np.ndarray:
    """The bits of the wanted hashes: of a fixed size, put together by Spark."""
    bit = F.col("g").bitwiseAND(FILTER_BITS - 1) + 1
    rows = wanted.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        at = (r.k - 1) * 4096
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def stuffed_pages(documents: DataFrame, doc: str, text: str, url: str, source: str) -> DataFrame:
    """``doc, words, list_words, doubtful_words, repeated_words, shared_words, share, stuffed`` for every page with at
    least one word.

    ``host`` is the url's host, or the source where there is no url. A page is stuffed if more than half of its words
    are ``list_words``: words outside content in replicated phrases. ``doubtful_words`` are all outside content, and of
    ``list_words`` the page itself repeats the phrases of ``repeated_words``, other hosts use those of ``shared_words``. Null and empty texts give
    no row; of rows that repeat an id the one with most stuffing counts; texts are read whole.

    The hosts of the phrases of pages with enough doubtful words, and of their words, are counted over the shingles of
    all texts; a filter of bounded size keeps other phrases from being shuffled, and the counts are pre-aggregated. No
    list of pages is ever collected for a phrase.
    """
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lower(F.col(source)), F.lit(""))
    texts = spread(documents.select(F.col(doc).cast("long").alias("doc"), host.alias("host"), F.col(text).alias("t")))
    pages = stored(texts.mapInArrow(_scan, _DDL))
    asked = pages.where("size(phrases) > 0").select("page", "host", F.explode("phrases").alias("z")).select("page", "host", "z.*")
    wanted = asked.select(F.explode(F.array_compact(F.array("p", "a", "b"))).alias("g")).distinct()
    shared = documents.sparkSession.sparkContext.broadcast(_filter(wanted))
    used = texts.select("host", "t").mapInArrow(_shingles(shared), "host string, grams array<long>").select(F.explode("grams").alias("g"), "host")
    # a page's phrases are counted for its own host in any case, also those beside a link that its text has elsewhere
    n = stored(used.union(asked.select("p", "host")).distinct().groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= HOSTS))
    count = lambda c: n.select(F.col("g").alias(c), F.col("n").alias(f"n_{c}"))
    hosts = texts.agg(F.count_distinct("host").alias("hosts"))
    # a phrase that all hosts use says nothing
    known = asked.select("p", "a", "b").distinct().join(count("p"), "p").crossJoin(F.broadcast(hosts)).where(F.col("n_p") < F.col("hosts"))
    association = F.log(F.col("n_p") * F.col("hosts") / (F.col("n_a") * F.col("n_b"))) / F.log(F.col("hosts") / F.col("n_p"))
    associated = known.where("a is not null").join(count("a"), "a").join(count("b"), "b").where(association >= ASSOCIATION)
    replicated = known.where("a is null").select("p").union(associated.select("p")).distinct()
    hits = asked.select("page", "p").join(replicated, "p", "left_semi").groupBy("page").agg(F.collect_set("p").alias("hits"))
    weighed = pages.where("size(tokens) > 0").select("page", "doc", "link", "tokens", "lines", "runs").join(hits, "page", "left").select("doc", "link", "tokens", "lines", "runs", "hits").mapInArrow(_weigh, "doc long, own double, others double, w double")
    stuffing = weighed.groupBy("doc").agg(F.max("own").alias("own"), F.max("others").alias("others"), F.max("w").alias("w"))
    per = pages.groupBy("doc").agg(F.max("words").alias("words"), F.max("doubtful").alias("doubtful"))
    out = per.join(stuffing, "doc", "left").select(F.col("doc").alias(doc), "words", *(F.round(F.coalesce(c, F.lit(0.0)), 3).alias(name) for c, name in (("w", "list_words"), ("doubtful", "doubtful_words"), ("own", "repeated_words"), ("others", "shared_words"))))
    share = F.col("list_words") / F.col("words")
    return out.select("*", F.round(share, 6).alias("share"), (share > SHARE).alias("stuffed"))
