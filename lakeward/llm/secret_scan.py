"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

A candidate is a long unbroken run of key characters, or what base spans leave
of one, in a text that holds a sensitive word, before or after it, on its line or another.  Its novelty is
the number of bytes that it adds to a compressed block of ordinary names, the
identifiers it shares with the rest of its text and the corpus's words.  It is
reported when that is more than ordinary names of its length add; a random key
adds nearly its own entropy.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lakeward.functions.keyed import packed_join
from lakeward.llm.common import row_slices, text_buffers
from lakeward.session import materialize

# Fixed patterns of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS = 12, 18

SENSITIVE = re.compile(r"(?:passw(?:or)?d|pwd|secret|token|(?:api|access|private|auth|aws|signing|encryption)[ _-]?key|credential|bearer|authorization|signature)", re.I | re.A)
MIN_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

# Names and phrases that make ordinary code predictable.
IDENTIFIERS = " ".join((
    "password passwd secret token api_key apikey access_key private_key credential authorization bearer signature "
    "client_id client_secret username database connection string config settings environment variable default value "
    "example placeholder changeme your_password_here your-api-key-here insert_token_here xxxxxxxxxxxxxxxx "
    "import from return function class public static final private protected const let var int float double boolean "
    "get_secret_value getAccessToken refreshToken tokenizer_config max_tokens token_type_ids password_reset_required "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1234567890123456 "
    "http https www com org net index html application json content type length encoding utf-8 base64 sha256").split())

ORDINARY_WORDS = (
    "action active address agent alert alias amount analytics anchor answer app append argument array asset async attach attribute author avatar backup "
    "balance banner base bin bind block body bookmark border branch browser bucket buffer build bundle cache calendar callback cancel canvas capture cart "
    "catalog category center channel chapter check checkout child city class clean click client clock close cloud cluster collect color column comment "
    "commit common compare compile complete compute condition config connect console constant container content context convert copy core country coupon "
    "cover credit current cursor customer daily dashboard database date deadline decode default define delete deliver demo depth design detail dialog "
    "digest direct discount display docs domain download draft duration dynamic edge editor element email empty enable encode entity entry error event "
    "events example execute exit expand export extend external failure feature feedback field figure file filter final finance first flag flight folder "
    "follow footer form format forward friend front function game gateway generate grant graph grid guest guide handle hash header health helper helpers "
    "hidden holder home hook hotel hour icon import inbox include info inline input inspect install instance internal invoice item iterator join journal "
    "keyboard keys label large last latency layout leader leave legacy length level library license light line link list load local locale lock logger "
    "login lookup machine magic manage manager manual margin market master matrix maximum measure member memory menu message meta method middle migrate "
    "minimum model modify module month monthly mouse music name native node normal note number object offer offset online open opt option options order "
    "orders origin owner package page panel paper params parse partial partner path pattern payment people percent period phone photo picture plan platform "
    "player point policy pool port post power premium prepare preview primary print private product profile program project prompt property provider proxy "
    "public purchase query queue random range rating reader record recover reduce refer refresh register release remote rename render repair replace reply "
    "report require reserve reset resolve resource response result results resume return review right room root rotate route router rule runtime sale "
    "sample scale scan schedule scope score screen scroll search season section secure segment sender sequence serial service session setting setup shadow "
    "shape sheet shell shipping short sidebar signal single site size slider slot small social socket sort space special speed src stack staff standard "
    "start state station status step stop storage store stream street string student style submit summary supplier support symbol sync system target task "
    "team temporary term test text theme thread ticket time timer toggle tool tooltip trace track trade train transfer translate tree trigger type unit "
    "update upgrade usage user users utils valid value var vector vendor version vertical video visible visit visitor wallet warning watch weather week "
    "weight width window wizard wrapper write www zone "
).split()

# Marginal bytes of ordinary names of n characters stay below OWN_BYTES + BYTE_SHARE * n: fitted on 1,300 seeded names built from words
# that are not in ORDINARY_WORDS (8 % lie above; 98 % of random letters and digits do); tests/llm holds other names and keys against it.
OWN_BYTES, BYTE_SHARE = 0.5, 0.7

PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}|[0-9]{3,}")  # a name's words and numbers
CORPUS_WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,15}+(?![A-Za-z0-9+/_=-])"  # never a piece of a candidate


def ordinary_names(words: list[str], n: int, seed: int) -> list[str]:
    """Seeded names in the usual styles: snake, camel, path, dashed and upper
    case, some with a number, version or date."""
    r, out = random.Random(seed), []
    for _ in range(n):
        p, style = [r.choice(words) for _ in range(r.randint(2, 5))], r.randrange(6)
        name = ("_".join(p), p[0] + "".join(map(str.title, p[1:])), "/".join(p), "-".join(p), "_".join(p).upper(), "".join(map(str.title, p)))[style]
        date = ("-" if style == 3 else "_") + f"{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
        out.append(name + ("", "", str(r.randint(1, 9999)), f"_v{r.randint(1, 30)}", date)[r.randrange(5)])
    return out


_TOOLS: list = []


def _tools():
    if not _TOOLS:
        prime = " ".join([IDENTIFIERS, *ORDINARY_WORDS, *map(str.upper, ORDINARY_WORDS), *ordinary_names(ORDINARY_WORDS, 150, 1)]) + "\n"
        _TOOLS[:] = [zstandard.ZstdCompressor(level=19, write_checksum=False, write_content_size=False), prime.encode(), {}]
    return _TOOLS


def novelty(candidate: str, known: list[str]) -> int:
    """Bytes that ``candidate`` adds to a compressed block of ordinary names
    and the ``known`` identifiers.  One block holds all, so the candidate's
    characters are coded by the statistics of names, not stored raw."""
    tool, prime, alone = _tools()
    block = prime + (" ".join(known) + "\n").encode()
    if not known and "" not in alone:
        alone[""] = len(tool.compress(block))
    return len(tool.compress(block + candidate.encode())) - (len(tool.compress(block)) if known else alone[""])


def limit(length: int) -> float:
    """Marginal bytes that ordinary names of this length stay below."""
    return OWN_BYTES + BYTE_SHARE * length


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


Candidate = tuple[int, int, str, list[tuple[str, bool]], bool]  # start, end, name, its parts and whether the text knows them, met again


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[Candidate]:
    """Every run of key characters of a text that holds a sensitive word,
    wherever the word stands; of a run that base spans cover in part, what
    they leave, where that is long enough."""
    if SENSITIVE.search(text) is None:
        return []
    taken, at, test = sorted((a, b) for a, b, _ in base), 0, []
    for m in CANDIDATE.finditer(text):
        a, end = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        k = at
        while a < end:  # what stands before the next base span
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            b = min(end, taken[k][0]) if k < len(taken) else end
            if b - a >= MIN_CANDIDATE and any(map(str.isalpha, text[a:b])):
                test.append((a, b, a == m.start() and b == end))
            a = max(a, b if b == end else taken[k][1])
    if not test:
        return []
    parts, runs = Counter(p.lower() for p in PART.findall(text)), Counter(CANDIDATE.findall(text))
    out = []
    for a, b, whole in test:
        name = text[a:b]
        inside = PART.findall(name)
        own = Counter(map(str.lower, inside))
        out.append((a, b, name, [(p, parts[p.lower()] > own[p.lower()]) for p in dict.fromkeys(inside)], runs[name] > whole))
    return out


def novel_spans(found: list[Candidate], corpus: Container[str] = frozenset(), min_bytes: int = 12) -> list[tuple[int, int, str]]:
    """Spans of the candidates whose novelty is at least ``min_bytes`` and
    above that of ordinary names of their length.  Known to a candidate are
    the identifiers of the rest of its text and the lower-case words of
    ``corpus``."""
    out = []
    for a, b, name, inside, again in found:
        known = [p for p, told in inside if told or p.lower() in corpus] + [name] * again
        if (n := novelty(name, known)) >= min_bytes and n > limit(len(name)):
            out.append((a, b, "novel"))
    return out


def scan(text: str, corpus: Container[str] = frozenset()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    return base, novel_spans(candidates(text, base), corpus)


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w): the lower-case words that stand in two rows at least.  Runs long
    enough to be candidates are not read, so a key in many copies is not
    learned.  Partial sums are taken before the shuffle."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(CORPUS_WORD), F.lit(0)), lambda w: F.lower(w)))
    return docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("w")


def write_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


CANDIDATES = "array<struct<start:int,end:int,name:string,parts:array<struct<part:string,known:boolean>>,again:boolean>>"


def read_spans(spans: str) -> list[tuple[int, int, str]]:
    return [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_assign, n_access, n_hex, n_novel, base and spans.

    base and spans list kind:start:end (code points, end exclusive) by start,
    then kind; spans also holds the novel ones.  A null or empty text has no
    span; repeated rows are scanned each; an empty table gives an empty
    result; other columns are not read.  One narrow pass over whole texts finds
    base spans and candidates; the words that candidates are made of are
    looked up in the corpus's words by a join, whatever their number; a second
    pass over the candidates alone measures their novelty."""
    row, told = "_scan_row", "_scan_known"
    first = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL("base string, found " + CANDIDATES).fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in row_slices(text_buffers(texts)[1], 8 << 20):
                bases = [(t or "", base_spans(t or "")) for t in texts.slice(a, b - a).to_pylist()]
                found = [[{"start": x, "end": y, "name": n, "parts": [{"part": p, "known": k} for p, k in inside], "again": again}
                          for x, y, n, inside, again in candidates(t, base)] for t, base in bases]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([write_spans(base) for _, base in bases], pa.string()),
                                                  pa.array(found, to_arrow_type(first["found"].dataType))], names=first.names)

    passed = materialize(docs.select(id_col, docs[text_col].alias("_scan_text")).mapInArrow(find, first)
                         .withColumn(row, F.monotonically_increasing_id()), "candidates")
    asked = passed.select(row, F.explode(F.array_distinct(F.flatten(F.transform("found", lambda c: F.transform(
        F.filter(c["parts"], lambda p: ~p["known"]), lambda p: F.lower(p["part"])))))).alias("w"))
    known = packed_join(asked, corpus_words(docs, text_col), ["w"], ["w"], "left_semi").groupBy(row).agg(F.collect_set("w").alias(told))
    kinds = (*KINDS, "novel")
    schema = T.StructType([first[id_col], *T.StructType.fromDDL("n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base string, spans string").fields])
    order = {k: i for i, k in enumerate(kinds)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, found, words in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                spans = read_spans(base)
                novel = novel_spans([(c["start"], c["end"], c["name"], [(p["part"], p["known"]) for p in c["parts"]], c["again"]) for c in found], frozenset(words or ()))
                both = sorted(spans + novel, key=lambda s: (s[0], order[s[2]]))
                out.append([*(sum(k == kind for *_, k in both) for kind in kinds), base, write_spans(both)])
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=schema.names)

    return passed.join(known, row, "left").select(id_col, "base", "found", told).mapInArrow(judge, schema)
