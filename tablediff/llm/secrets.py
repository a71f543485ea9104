"""Secret scans: candidate strings by pattern, false positives removed by a random forest.

A candidate is, each of any length: a private key block; a value of at least LEAST_VALUE characters that is assigned to a
name such as password, quoted (blanks are part of it, up to the quote or the end of the line) or not; the password, or a user
of LEAST_LENGTH characters, before the @ of a URL; a quoted value of LEAST_LENGTH characters without blanks; a bare run of as many
key or percent-encoded characters. Only the bare run must have a digit or mixed case (or a known prefix): what is assigned,
quoted or stands in a URL goes to the forest whatever it is made of. The forest sees its length, how characters change class and
follow one another, how much of it dictionary words cover, the path it stands in, and the words around it.

It is trained on labelled findings: (before, candidate, after, path, label) rows. Where a caller has none, a fixed
set is drawn by rule from the public shapes of keys and of look-alikes (digests after commit or sha256, UUIDs,
placeholders, identifiers, expressions, captions, addresses, file paths, numbers); at most TRAIN_ROWS rows are used.

Cases: null and empty texts have no findings; a null path counts as empty. Overlapping candidates are
reported once, the longest at the earliest place. Repeated rows give repeated findings, null ids are kept.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, released, ship, unship, whole_text

LEAST_LENGTH, LEAST_VALUE, THRESHOLD, TRAIN_ROWS, AROUND = 16, 6, 0.5, 20_000, 48

#: Words that announce a secret, and words that announce something that only looks like one.
ANNOUNCE = frozenset("access api apikey auth authorization bearer client credential credentials key passphrase passwd password private pwd secret session signing token".split())
DENY = frozenset("blob changeset checksum commit digest etag example fingerprint git guid hash id integrity md5 page placeholder revision sample sha sha1 sha256 sha512 test tree uuid version".split())
#: Words of which captions, placeholders and expressions in place of a secret are made.
SPOKEN = ANNOUNCE | frozenset("a an and are be cannot changeme does enter environ example expired field for from function getenv getpass has here input invalid is it least missing must my none not null of os placeholder please process refresh request required reset sample self settings should str string test the this to undefined use user value was will with your".split())
#: Common words of code and prose, for coverage.
DICTIONARY = frozenset("access account action admin after agent alert alpha array async author back base batch before beta block body build button cache call change channel check child class client close code color column command common component config connection console container content context control copy core count create current data date debug default delete demo design detail device dialog display document domain down driver dummy edit element email enable end engine entry error event example factory field file filter first folder font form format frame from function general global group handler hash head header help hidden home host icon image import index info init input inner install instance interface internal item java json key label language last layout left length level library line link list load local lock log login main make manager map mark master member memory menu message method model module month mount name native network next node null number object offset open option order output page panel parent parse password path pattern placeholder player point pool port position post prefix press print private process product profile project property protocol provider public query queue random range read record region release remote remove render report request reset resource response result return right role root route rule sample save scale schema scope screen script search second secret section select server service session set size source spec stack start state static status storage store stream string style submit suite super switch symbol system table target task template test text theme thread time title token tool total track transfer transform tree type under unit update upload user util value variable vector version video view web widget width window word work wrapper write year your zone".split())

KEY = r"[A-Za-z0-9+/=_\-]"
MARKER = r"-----(?:BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
BLOCK = re.compile(rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:(?!{MARKER})-[^-]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
ENCODED = rf"(?:{KEY}|%[0-9A-Fa-f]{{2}})"
RUN = re.compile(rf"(?<![A-Za-z0-9+/=_\-.])(?:eyJ{KEY}++\.{KEY}++\.{KEY}++|{ENCODED}{{{LEAST_LENGTH},}}+)")
NAMED = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*=")
QUOTED = re.compile(r"(?<![^\s\"'<>])[^\s\"'<>]{6,}+(?=[\"'])")
NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|signature)"
#: An assigned value: in double quotes, in single quotes, or up to the next blank or quote.
VALUE = re.compile(rf"{NAME}[\"']?\s*+[:=]\s*+(?:\"((?:[^\"\\\n]|\\.){{{LEAST_VALUE},}}+)(?=\")|'((?:[^'\\\n]|\\.){{{LEAST_VALUE},}}+)(?=')|[\"']?(?![=:])([^\s\"'<>]{{{LEAST_VALUE},}}+)([\"']?))")
ASSIGNED = re.compile(rf"{NAME}[\"']?\s*[:=]\s*[\"']?$")
#: User and password before the last @ of the authority of a URL.
LOGIN = re.compile(rf"://([^\s/:@\"'<>]*+)(?::([^\s/\"'<>]{{{LEAST_VALUE},}}))?@")
IN_URL = re.compile(r"://[^\s/:@\"'<>]*:$")
NEXT = re.compile(r"&[A-Za-z_][A-Za-z0-9_\-]*=")
NEIGHBOUR = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+\d*")
MIXED = re.compile(r"\d")
QUOTES = ("\"", "'")


def _bigrams() -> np.ndarray:
    """Log frequency of letter pairs in the dictionary."""
    counts = np.ones((26, 26))
    for w in DICTIONARY:
        for a, b in zip(w, w[1:]):
            counts[ord(a) - 97, ord(b) - 97] += 1
    return np.log(counts / counts.sum(1, keepdims=True))


BIGRAMS = _bigrams()
NAMES = ("length", "entropy", "class_changes", "case_changes", "letter_pairs", "covered", "digits", "upper", "lower", "hex", "distinct", "dashes", "path_depth", "test_path", "announced", "denied", "assigned", "quoted", "uuid", "run", "known_prefix", "blanks", "brackets", "names_itself", "in_url")
PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|ya29\.|eyJ|-----BEGIN|glpat-|npm_|SG\.")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def features(before: str, candidate: str, after: str, path: str) -> list[float]:
    n, c = len(candidate), candidate
    m = len(c)
    kinds = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "s" for x in c]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    case = sum({a, b} == {"u", "l"} for a, b in zip(kinds, kinds[1:]))
    counts = np.array([c.count(x) for x in set(c)], float)
    low = c.lower()
    pairs = [BIGRAMS[ord(a) - 97, ord(b) - 97] for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    covered, i = 0, 0
    while i < m:
        size = next((k for k in range(min(12, m - i), 3, -1) if low[i : i + k] in DICTIONARY), 0)
        covered, i = covered + size, i + max(size, 1)
    near = [w.lower() for w in NEIGHBOUR.findall(before)][-4:]
    longest = max((len(x) for x in re.findall(r"(.)\1*", c)), default=0) if m else 0
    runs = max((len(r.group(0)) for r in re.finditer(r"(.)\1*", c)), default=longest)
    return [math.log(n + 1), float(-(counts / m * np.log2(counts / m)).sum()), changes / m, case / m, float(np.mean(pairs)) if pairs else -4.0, covered / m, kinds.count("d") / m, kinds.count("u") / m, kinds.count("l") / m, sum(x in "0123456789abcdef" for x in c) / m, len(counts) / m, sum(x in "-_/." for x in c) / m, float(path.count("/")), float(bool(re.search(r"test|example|sample|fixture|mock", path, re.I))), float(sum(w in ANNOUNCE for w in near)), float(sum(w in DENY for w in near)), float(bool(ASSIGNED.search(before))), float(before[-1:] in "\"'`" and bool(before)), float(bool(UUID.fullmatch(c))), float(runs), float(bool(PREFIX.match(c))), sum(x.isspace() for x in c) / m, float(sum(x in "()[]{}$" for x in c)), float(sum(w.lower() in SPOKEN for w in NEIGHBOUR.findall(c))), float(bool(IN_URL.search(before)))]


def labelled_findings(rows: int = 6000, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings drawn by rule; the same for the same seed."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    words, an, hexes = sorted(DICTIONARY), string.ascii_letters + string.digits, "0123456789abcdef"
    prose = lambda: " ".join(pick(words) for _ in range(int(rng.integers(0, 6))))
    paths = ["", "src0", "src7", "src/main/app.py", "config/prod.env", "deploy/settings.yaml", "docs/readme.md"]
    ann = ["token", "api_key", "apikey", "secret", "password", "auth_token", "access_key", "client_secret", "private_key", "passwd"]
    key = [lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + draw(an, 36), lambda: "sk_live_" + draw(an, 24), lambda: "xoxb-" + draw(string.digits, 12) + "-" + draw(an, 24), lambda: "AIza" + draw(an + "-_", 35), lambda: draw(hexes, pick([32, 40, 48, 64])), lambda: draw(an, int(rng.integers(20, 64))), lambda: draw(an + "+/", 40), lambda: "eyJ" + draw(an, 30) + "." + draw(an, 60) + "." + draw(an + "-_", 43), lambda: draw(an + "!#%&*", int(rng.integers(8, 18)))]
    like = [lambda: draw(hexes, pick([32, 40, 64])), lambda: "-".join(draw(hexes, n) for n in (8, 4, 4, 4, 12)), lambda: "_".join(pick(words) for _ in range(int(rng.integers(3, 6)))), lambda: "".join(pick(words).title() for _ in range(int(rng.integers(3, 6)))) + str(rng.integers(100)), lambda: "/".join(pick(words) for _ in range(4)) + "/V" + str(rng.integers(10)), lambda: draw(string.digits, int(rng.integers(16, 24))), lambda: pick(["YOUR_API_KEY_HERE", "EXAMPLE_TOKEN_0000000000", "xxxxxxxxxxxxxxxx1234", "AAAAAAAAAAAAAAAAAAAA", "0000000000000000000000", "changeme_password_1"]), lambda: pick(words).title() + draw("aeiourstln", int(rng.integers(12, 24))), lambda: pick(["sha256-", "sha384-", "sha512-"]) + draw(an + "+/", pick([43, 64, 86])) + pick(["", "=", "=="])]
    deny = ["commit", "sha256", "sha1", "checksum", "md5", "uuid", "id", "revision", "integrity", "etag", "digest"]
    join = [' = "', ': "', "=", ": ", "='", ' := "']
    out = []
    for i in range(rows):
        label = i % 2
        if label:
            k = int(rng.integers(len(key)))
            said = pick(ann) + pick(join) if k >= 5 or rng.random() < 0.6 else pick(["", "use ", "curl -H "])
            out.append((f"{prose()} {said}", key[k](), pick(['"', "'", " ", ""]), pick(paths), 1))
        else:
            k = int(rng.integers(len(like)))
            said = pick(deny) + pick(join + [" "]) if k in (0, 1, 8) or rng.random() < 0.4 else pick(["", "", pick(words) + " ", pick(ann) + pick(join) if k == 6 else ""])
            path = pick(paths + ["tests/fixtures/data.json", "package-lock.json"])
            out.append((f"{prose()} {said}", like[k](), pick(['"', " ", ""]), path, 0))
    low, base32 = string.ascii_lowercase, string.ascii_uppercase + "234567"
    code = ["os.environ", "getpass.getpass()", "request.form.get(key)", "config.load_token()", "process.env.API_KEY", "settings.SECRET", "self.token", "undefined", "required", "string", "optional", "String", "str|None", "${DB_PASSWORD}", "${{secrets.TOKEN}}", "{{password}}", "$(cat", "changeme", "your-password-here", "your_token", "******", "xxxxxxxx", "function(user)", "(string)"]
    phrase = lambda: " ".join(pick([pick(words), pick(words).title(), draw(an, int(rng.integers(2, 7))), str(rng.integers(100)), draw(low + "!&0123", 6)]) for _ in range(int(rng.integers(2, 6))))
    caption = lambda: pick([str, str.capitalize, str.title])(" ".join([pick(["please enter", "the", "your", "invalid", "missing", "this", "use a", "forgot your", "must be", "reset"]), *(pick(words + sorted(SPOKEN)) for _ in range(int(rng.integers(1, 5))))]))
    login = lambda: f"{prose()} {pick(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb+srv', 'ftp'])}://{pick(['admin', 'root', 'app', 'svc_' + pick(words), pick(words), ''])}:"
    host = lambda: f"@{pick(words)}.{pick(['local', 'example.com', 'internal:5432'])}/{pick(words)}"
    named = lambda q="": f"{prose()} {pick(['db_', 'user_', '', '', 'app-', 'MY_'])}{pick(ann)}{pick(['=', ' = ', ': ', ':'])}{q}"
    address = lambda: f"{pick(['https://', 'http://', '/', ''])}{pick(words)}{pick(['.example.com', '.org', ''])}/{pick(words)}/{pick(words)}{pick(['.html', '.js', '', '-' + pick(words)])}"
    label_of = lambda: f"{prose()} {pick(['href=', 'class=', 'src=', 'name: ', 'import ', 'type=', ''])}"
    shapes = [
        (1, named, lambda: draw(low, int(rng.integers(8, 18))), ""), (1, lambda: named('"'), lambda: draw(low + string.digits, int(rng.integers(7, 16))), '"'), (1, lambda: named('"'), phrase, '"'), (1, lambda: named("'"), phrase, "'"), (1, named, lambda: draw(an + "!#$%&*@^", int(rng.integers(8, 20))), "\n"), (1, lambda: named(pick(["", '"'])), lambda: draw(pick([base32, string.ascii_uppercase]), pick([16, 26, 28, 32])), ""), (1, login, lambda: draw(pick([an, low, an + "!$%*"]), int(rng.integers(8, 20))), host), (1, lambda: f"{prose()} {pick(['sig=', 'sv=1&sig=', '?signature=', 'key='])}", lambda: draw(an, int(rng.integers(6, 30))) + pick(["%2F", "%2B"]) + draw(an, int(rng.integers(8, 24))) + pick(["", "%3D", "%3D%3D"]), pick(["&", " ", ""])),
        (0, named, lambda: pick(code), pick(["", ";", "\n"])), (0, lambda: named(pick(["'", '"'])), caption, pick(["'", '"'])), (0, lambda: named(pick(["", '"'])), lambda: pick(["_", "-", ".", ""]).join([pick(words), pick(sorted(SPOKEN)), pick(words)][: int(rng.integers(2, 4))]), ""), (0, lambda: f"{prose()} {pick(ann)}: ", lambda: pick(words + sorted(w for w in SPOKEN if len(w) >= LEAST_VALUE)), " "), (0, login, lambda: pick(["password", "passwd", "PASSWORD", "${PASSWORD}", "$DB_PASS", "secret", "xxxxxx", "******", "yourpassword", "{password}"]), host), (0, lambda: label_of() + pick(["'", '"']), address, '"'), (0, lambda: label_of() + '"', lambda: pick(["-", "_", "."]).join(pick(words) for _ in range(int(rng.integers(3, 5)))), '"'), (0, lambda: f"{prose()} {pick(['q=', 'url=', 'title=', ''])}", lambda: "%20".join(pick(words) for _ in range(int(rng.integers(3, 6)))), pick(["&", " "])),
    ]
    for i in range(rows):
        label, before, value, after = shapes[i % len(shapes)]
        text = value()
        if len(text) >= LEAST_VALUE:
            out.append((before(), text, after() if callable(after) else after, pick(paths), label))
    return out


class RandomForest:
    """Trees on bootstrap samples, each node cut at the best of a few features by Gini gain over quantile bins."""

    def __init__(self, trees: int = 40, depth: int = 10, least: int = 4, bins: int = 32, seed: int = 1):
        self.trees, self.depth, self.least, self.bins, self.seed = trees, depth, least, bins, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng = np.random.default_rng(self.seed)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bins(x)
        self.grown = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list] = [[-1, 0, 0, 0, 0.0]]  # feature, cut, left, right, share
            todo = [(0, rows, 0)]
            while todo:
                k, own, depth = todo.pop()
                share = y[own].mean()
                nodes[k][4] = float(share)
                if depth == self.depth or len(own) < 2 * self.least or share in (0.0, 1.0):
                    continue
                best = (1e-12, -1, 0)
                for j in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                    n = np.bincount(binned[own, j], minlength=self.bins).cumsum()
                    p = np.bincount(binned[own, j], y[own], self.bins).cumsum()
                    total, ones = n[-1], p[-1]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.nan_to_num(p * p / n + (ones - p) ** 2 / (total - n)) - ones * ones / total
                    gain[(n < self.least) | (total - n < self.least)] = -1
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], int(j), at)
                if best[1] < 0:
                    continue
                left = binned[own, best[1]] <= best[2]
                nodes[k][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
                nodes += [[-1, 0, 0, 0, 0.0], [-1, 0, 0, 0, 0.0]]
                todo += [(nodes[k][2], own[left], depth + 1), (nodes[k][3], own[~left], depth + 1)]
            self.grown.append([np.array(c) for c in zip(*nodes)])
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, rows, out = self._bins(x), np.arange(len(x)), np.zeros(len(x))
        for feature, cut, left, right, share in self.grown:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                step = np.where(binned[rows, f] <= cut[node], left[node], right[node])
                node = np.where(f < 0, node, step)
            out += share[node]
        return out / len(self.grown)


def train(findings: list[tuple[str, str, str, str, int]] | None = None) -> RandomForest:
    rows = (labelled_findings() if findings is None else findings)[:TRAIN_ROWS]
    return RandomForest().fit(np.array([features(*r[:4]) for r in rows]), np.array([float(r[4]) for r in rows]))


def _fixed(text: str) -> Iterator[tuple[int, int, int]]:
    """Where what announces it begins, begin and end of key blocks and assigned values."""
    found, at = [(m.start(), m.start(), m.end()) for m in BLOCK.finditer(text)], 0
    for m in VALUE.finditer(text):
        if m[3] is None:
            found.append((m.start(), *m.span(m.lastindex)))
            continue
        end = m.end(3) if m[4] else m.start(3) + len(NEXT.split(m[3], maxsplit=1)[0].rstrip(",;)]}"))
        if end - m.start(3) >= LEAST_VALUE:
            found.append((m.start(), m.start(3), end))
    for m in LOGIN.finditer(text):
        found += [(m.start(), *m.span(k)) for k, least in ((1, LEAST_LENGTH), (2, LEAST_VALUE)) if m[k] and len(m[k]) >= least]
    for first, begin, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if begin >= at:
            yield max(first, at), begin, end
            at = end


def _loose(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Runs of key characters and quoted values between low and high, from the left."""
    quoted = [m.span() for m in QUOTED.finditer(text, low, min(high + 1, len(text))) if m.end() <= high]
    k = 0
    while low < high:
        run = RUN.search(text, low, high)
        span = run.span() if run else (high, high)
        if run and (name := NAMED.match(text, *span)) and span[1] - name.end() >= LEAST_LENGTH:
            span = (name.end(), span[1])
        while k < len(quoted):
            a, b = quoted[k]
            if a < low or not a or text[a - 1] in "<>":
                a = next((i + 1 for i in range(max(a, low - 1), b) if text[i] in "=:"), b)
            if b - a >= 6:
                break
            k += 1
        if k < len(quoted) and a < (run.start() if run else high):
            span = (a, b)
        if span[0] >= high:
            return
        yield span
        low = span[1]


def find_candidates(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of every candidate, in order. Fixed ones come out as they are; of loose ones, bare runs need a digit or mixed case."""
    low = 0
    for first, begin, end in [*_fixed(text), (len(text),) * 3]:
        for a, b in _loose(text, low, first):
            found = text[a:b]
            if b - a < LEAST_LENGTH and not ASSIGNED.search(text[max(0, a - AROUND) : a]):
                continue
            quoted = text[b : b + 1] in QUOTES and text[a - 1 : a] in QUOTES and a > 0
            if quoted or MIXED.search(found) or PREFIX.match(found) or not (found.islower() or found.isupper() or found.istitle() or found.lower() == found.upper()):
                yield a, b
        if begin < end:
            yield begin, end
        low = end


def scan(docs: DataFrame, path: str = "source", findings: list | None = None) -> DataFrame:
    """doc_id, begin, end (code points), secret_sha256, score, is_secret of every candidate; rows with is_secret false are what the forest removed."""
    shared = ship(docs.sparkSession, train(findings))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = unship(shared)
        names = ["doc_id", "begin", "end", "secret_sha256", "score"]
        for batch in batches:
            out, x = [], []
            for doc, text, path in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("path").to_pylist()):
                text = text.as_py()
                for a, b in find_candidates(text):
                    x.append(features(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND], path))
                    out.append((doc, a, b, hashlib.sha256(text[a:b].encode()).hexdigest()))
            score = forest.predict(np.array(x)) if x else np.zeros(0)
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(score)], names)

    found = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), where.alias("path")).mapInArrow(released(run), "doc_id long, begin long, end long, secret_sha256 string, score double")
    return found.withColumn("is_secret", F.col("score") >= THRESHOLD)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
