"""Secret scans: values of secret-like names, passwords in addresses and long runs with digits are candidates; a random forest removes
the false positives. DataFrame operations only.

The forest sees a candidate's length, character transitions and shares, how much of it dictionary words cover, whether it lies in a path,
and its neighbouring words. It is trained on labelled findings, by default a seeded set of made-up ones, and applied as one SQL
expression, so scanning runs no Python.
"""

from __future__ import annotations

import random
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents
from .forest import forest_sql, grow_forest

#: How keys of well-known services begin; fixed values.
PREFIXES = "(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|xox[abp]-|eyJ)"
#: Names whose value is a candidate, and what may stand between name and value.
_NAME = r"(?i:key|secret|token|passw(?:or)?d|passphrase|pwd|credentials?|auth)"
_ASSIGNED = r"""["'`]?[ \t]{0,2}[:=]{1,2}[ \t]{0,2}["'`]?"""
#: The value of a secret-like name, of 6 or more characters; the password of an address; or a run of 16 or more characters of keys
#: that has a digit or begins as a service's key. An assignment sign ends a candidate, but for the padding of base 64, and so does the stop of a sentence.
_VALUE = r"""(?<=[:=][ \t]{0,2}["'`]?)(?<=NAMEASSIGNED)[^\s"'`<>,;(){}\[\]]{5,}[^\s"'`<>,;(){}\[\].:=]={0,2}""".replace("NAME", _NAME).replace("ASSIGNED", _ASSIGNED)
_ADDRESS = r"""(?<=:)(?<=://[^\s/:@"'`]{1,32}:)[^\s/@"'`]{3,}(?=@)"""
_RUN = r"(?<![A-Za-z0-9+/_.\-])(?=PREFIXES|[A-Za-z+/_.\-]*[0-9])[A-Za-z0-9+/_.\-]{15,}[A-Za-z0-9+/_\-]={0,2}".replace("PREFIXES", PREFIXES)
CANDIDATE = f"{_VALUE}|{_ADDRESS}|{_RUN}"
CONTEXT = 48
THRESHOLD = 0.5
NAMES = r"(?i)(key|secret|token|passw|passphrase|pwd|credential|auth|bearer|private|akia)"
PASSWORDS = r"(?i)(passw|passphrase|pwd)"
HARMLESS = r"(?i)(commit|sha|md5|checksum|digest|uuid|guid|hash|rev|build|version|isbn|image|file|path|example|phone|tel|order|card)"
WORDS = "access|account|admin|alpha|april|beta|build|class|client|commit|config|data|default|demo|docs|example|file|foo|home|http|image|index|internal|item|lib|local|main|master|model|name|node|order|page|param|path|placeholder|product|public|report|sample|script|section|server|service|source|static|string|style|system|table|test|text|title|token|usr|user|value|version|www|your|required|expired|invalid|missing|changed|incorrect|none|null|redacted|password|secret|key|environ|env|getpass|self|process"
FEATURES = ["f_len", "f_moves", "f_switch", "f_hard", "f_prefix", "f_password", "f_address", "f_digits", "f_upper", "f_kinds", "f_hex", "f_words", "f_path", "f_assigned", "f_name", "f_harmless"]


def features(candidate: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.char_length(candidate)
    kinds = F.translate(candidate, string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/=_.-", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 6)
    number = lambda c: c.cast("double")
    return {
        "f_len": number(n),
        "f_moves": number(F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "f_switch": number(F.regexp_count(candidate, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))) / n,
        "f_hard": number(F.regexp_count(candidate, F.lit("(?i)[b-df-hj-np-tv-xz]{3}"))) / n,
        "f_prefix": number(candidate.rlike("^" + PREFIXES)),
        "f_password": number(before.rlike(PASSWORDS)),
        "f_address": number(before.rlike(r"://[^\s/:@]{1,32}:$") & after.startswith("@")),
        "f_digits": number(F.char_length(F.translate(kinds, "aA-", ""))) / n,
        "f_upper": number(F.char_length(F.translate(kinds, "a0-", ""))) / n,
        "f_kinds": number(F.size(F.array_distinct(F.split(candidate, "")))) / n,
        "f_hex": number(candidate.rlike(r"^[0-9a-fA-F\-]+$")),
        "f_words": 1 - number(F.char_length(F.regexp_replace(F.lower(candidate), f"({WORDS})", ""))) / n,
        "f_path": number(candidate.rlike(r"[^/=]/[^/]+/|\.[a-z]{2,4}$|^/") | before.rlike(r"[/\\~]$")),
        "f_assigned": number(before.rlike(r"""[:=]\s*["'`]?$""")),
        "f_name": number(before.rlike(NAMES)),
        "f_harmless": number(F.concat(before, F.lit(" "), after).rlike(HARMLESS)),
    }


_FILLER = "the value is|see also|and then|in this|for more|with|we use|note that"
_PHRASES = "anchor|battery|copper|falcon|harbor|horse|hunter|meadow|monkey|orchid|purple|river|saddle|staple|summer|thunder|violin|winter"


def labelled_findings(n: int = 6_000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(candidate, text before, text after, 1 if it is a secret) of made-up findings; half of them are secrets: named keys, bare keys of
    known services, passwords short or made of words, passwords in addresses. The others are digests, ids, paths, names, numbers,
    hosts, placeholders, and what code or prose assigns to secret-like names without telling the secret."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    filler, words, phrases = _FILLER.split("|"), WORDS.split("|"), _PHRASES.split("|")
    name = lambda: r.choice(["token", "api_key", "API_KEY", "secret", "client_secret", "auth token", "access key", "private key", "AWS_SECRET_ACCESS_KEY", "credentials"])
    password = lambda: r.choice(["password", "passwd", "pwd", "DB_PASSWORD", "passphrase", "Password"])
    sign = lambda: r.choice([" = \"", "=", ": ", ":\"", "='", "\": \""])

    def service() -> str:
        return r.choice([f"AKIA{pick(string.ascii_uppercase + string.digits, 16)}", f"ghp_{pick(alnum, 36)}", f"sk-{pick(alnum, 32)}", f"eyJ{pick(alnum + '_-', 60)}", f"glpat-{pick(alnum, 20)}", f"xoxb-{pick(string.digits, 12)}-{pick(alnum, 24)}"])

    def short() -> str:
        w = r.choice(phrases)
        return r.choice([w + pick(string.digits, r.randint(1, 4)), w.title() + pick(string.digits, 2) + r.choice("!@#$%"), w + pick(string.digits, 1) + pick(string.ascii_lowercase, 3), pick(alnum + "!@#$%", r.randint(8, 14)), r.choice("-_.").join(r.choice(phrases) for _ in range(4))])

    def secret(around: str, after: str) -> tuple[str, str, str]:
        kind = r.random()
        if kind < 0.45:
            key = r.choice([pick(hexa, r.choice((32, 40, 64))), pick(alnum, r.randint(16, 64)), pick(alnum + "+/", 40), service()])
            return key, around + name() + r.choice([sign(), " is "]), r.choice(["\"", ""]) + after
        if kind < 0.6:
            return service(), around, after
        if kind < 0.85:
            return short(), around + password() + sign(), r.choice(["\"", ""]) + after
        return short().replace("@", "#"), f"{around}{r.choice(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{r.choice(['admin', 'app', 'root', 'svc', 'user'])}:", f"@{r.choice(words)}.{r.choice(['internal', 'com', 'local'])}/{r.choice(words)}"

    def other(around: str, after: str) -> tuple[str, str, str]:
        kind = r.randrange(12)
        if kind == 0:
            return pick(hexa, 40), around + r.choice(["commit ", "sha1: ", "rev ", "checksum = "]), after
        if kind == 1:
            return str(uuid.UUID(int=r.getrandbits(128))), around + r.choice(["uuid ", "id ", "guid: "]), after
        if kind == 2:
            return "/".join(r.choice(words) for _ in range(4)) + f"/v{r.randint(1, 9)}.{r.choice(('py', 'html', 'json'))}", around + r.choice(["path ", "file ", "see /"]), after
        if kind == 3:
            return "-".join(r.choice(words) for _ in range(4)) + str(r.randint(1, 2030)), around, after
        if kind == 4:
            return "-".join(pick(string.digits, 4) for _ in range(4)), around + r.choice(["card ", "order ", "tel "]), after
        if kind == 5:
            return pick(string.digits, r.randint(16, 24)), around, after
        if kind == 6:
            return f"{r.choice(['your', 'example', 'sample', 'placeholder'])}{r.choice('_-')}{r.choice(['token', 'value', 'user', 'password', 'secret'])}{r.choice(['', '_' + pick(string.digits, 4)])}", around + r.choice([name(), password()]) + sign(), after
        if kind == 7:
            return f"{pick(string.ascii_lowercase, 6)}.{r.randint(10, 99)}.{pick(string.ascii_lowercase, 7)}.com", around + r.choice(["mail ", "at ", ""]), after
        if kind in (8, 9):  # what prose says of a password or token
            return r.choice(["required", "expired", "invalid", "missing", "changed", "incorrect", "redacted", "default", "private", "********", "xxxxxxxx"]), around + r.choice([name(), password()]) + r.choice([": ", "=", " = "]), after
        if kind == 10:  # what code reads it from
            return r.choice(["os.environ", "self.password", "config.token", "process.env.TOKEN", "getpass.getpass", "settings.API_KEY", "user.password"]), around + r.choice([name(), password()]) + r.choice([" = ", "=", ": "]), r.choice(["", "(", "["]) + after
        return r.choice(["_", "-", ":", "."]).join(r.choice(words) for _ in range(r.randint(2, 3))) + r.choice(["", str(r.randint(1, 99))]), around + r.choice(["sort key", "primary key", "key", "cache_key", "foreign key"]) + r.choice([": ", "=", " = \""]), after

    out = []
    for k in range(n):
        around, after = f"{r.choice(filler)} ", f" {r.choice(filler)}"
        out.append((*(secret if k % 2 else other)(around, after), k % 2))
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]]) -> str:
    """The forest of labelled findings (a bounded list) as a SQL expression over the fields of a struct x of features."""
    rows = spark.createDataFrame(findings, "candidate string, before string, after string, label int")
    got = rows.select("label", *[c.alias(k) for k, c in features(F.col("candidate"), F.col("before"), F.col("after")).items()]).collect()
    table = np.asarray([list(r) for r in got], float)
    return forest_sql(grow_forest(table[:, 1:], table[:, 0]), [f"x.{k}" for k in FEATURES])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, candidate, start (characters before it), before and after (a few characters) of every candidate in whole texts."""
    # the text between candidates and the candidates take turns
    cut = docs.filter("doc_id is not null").select("doc_id", "text").filter(F.col("text").rlike(CANDIDATE))
    parts = cut.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.split("text", CANDIDATE).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    zipped = F.arrays_zip(F.col("gaps"), F.col("found"), F.slice("gaps", F.lit(2), F.size("gaps") - 1).alias("next"))
    each = parts.select("doc_id", "_row", F.posexplode(zipped).alias("k", "z")).filter("z.found is not null")
    each = each.select("doc_id", "_row", "k", F.char_length("z.gaps").alias("gap"), F.col("z.found").alias("candidate"), F.right(F.col("z.gaps"), F.lit(CONTEXT)).alias("before"), F.left(F.col("z.next"), F.lit(CONTEXT)).alias("after"))
    past = Window.partitionBy("doc_id", "_row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum((F.col("gap") + F.char_length("candidate")).cast("long")).over(past) - F.char_length("candidate")
    return each.select("doc_id", "candidate", start.alias("start"), "before", "after")


def scan(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, secret, score of each candidate that the forest takes for a secret.

    Null and empty texts hold none; a candidate that occurs twice is found twice; rows without doc_id are left out. Other columns are ignored."""
    model = train(docs.sparkSession, labelled_findings() if findings is None else findings)
    found = candidates(docs)
    known = F.struct(*[c.alias(k) for k, c in features(F.col("candidate"), F.col("before"), F.coalesce("after", F.lit(""))).items()])
    # the lambda and the generator keep each feature from being copied to all places that use it
    scored = found.withColumn("_known", known).select("doc_id", "start", F.col("candidate").alias("secret"), F.expr(f"explode(transform(array(_known), x -> {model}))").alias("score"))
    return scored.filter(F.col("score") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, their secrets as digests."""
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "start", F.char_length("secret").cast("long").alias("length"), F.sha2("secret", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
