"""Secret scans whose false findings a random forest takes away.

Candidates are values given to a name, quoted strings, keys with a known prefix
and long runs of characters, several to a word where it has several. A forest
scores each by the candidate's length and make-up, how usual its neighbouring
characters are beside each other, how much of it is dictionary words, whether it
is built like a path, an address or a number, and the words beside it. Which
words there are and which letters follow each other is counted over the whole
corpus. The forest learns from labelled findings. DataFrame functions and the
forest of Spark's own library only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.rows import computed_once
from quire.llm.tables import words_of, written

MIN_CHARS = 12
#: Labelled findings that a forest is fitted on, those of the lowest hashes.
MAX_FINDINGS = 20_000
#: Findings that are planted where nobody has labelled any.
PLANTED = 8_000
TREES, DEPTH, SEED = 32, 8, 11
THRESHOLD = 0.5
#: Words of the dictionary: in at least so many documents, and the most frequent ones of these.
MIN_DOCS, MAX_WORDS = 3, 100_000
#: The dictionary as a set of bits, 2**BITS of them; a word sets two.
BITS = 21

#: Parts of words that aren't secrets, in the dictionary whatever the corpus is.
DICTIONARY = (
    "about", "after", "back", "code", "com", "data", "date", "example", "file", "from", "have",
    "home", "html", "http", "image", "index", "info", "license", "line", "list", "mail", "main",
    "make", "name", "net", "number", "org", "page", "part", "path", "public", "site", "test",
    "text", "that", "this", "time", "user", "version", "view", "web", "with", "word", "work", "www",
)
_KEYWORD = "token|secret|passw|pwd|api_?key|access|auth|bearer|credential|private"
_PLAIN = "version|license|commit|sha|uuid|issue|page|phone|card|mail|address|serial|number"

# Below are patterns of SQL literals: backslashes are doubled, quotes are \\x22 and \\x27.
# Everything that may repeat ahead of what decides has a bound, so that no text is slow.
_Q = r"[\\x22\\x27]"
#: Names whose values are secrets whatever they look like.
_SECRET_NAME = "token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential"
_SHORT_NAME = "pw|pass"
_NAMES = rf"(?:(?:{_SECRET_NAME})[\\w.-]{{0,40}}+|(?<![\\w.-])(?:{_SHORT_NAME}))"
_NAMED = rf"(?i){_NAMES}{_Q}?[ \\t]{{0,8}}[=:]"
#: The same at the end of the words ahead.
_NAMED_END = rf"(?i)({_NAMES}){_Q}? ?[=:]{{1,2}}$"
_PREFIX = (
    r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|(?:gh[pousr]_|xox[abp]-|sk_live_)[0-9A-Za-z-]{16,})"
)
_NAME = r"[A-Za-z_][\\w.-]{0,39}"
#: Name (1) and value (2: in double quotes, 3: in single ones, 4: in none); a quoted string (5); a run (6).
_PIECE = (
    r"(?:(?<=[=:\\s])" rf"(?<=(?<![\\w.-])({_NAME}){_Q}?[ \\t]{{0,3}}[=:]{{1,2}}[ \\t]{{0,3}})(?!//|[=:\\s])"
    r"(?:\\x22([^\\x22\\n]*)\\x22|\\x27([^\\x27\\n]*)\\x27|([^\\s\\x22\\x27&;,<>(){}\\[\\]|]+)))"
    rf"|(?<![^\\s=:,(\\[{{])\\x22([^\\x22]{{{MIN_CHARS},}})\\x22"
    rf"|(?!{_NAME}{_Q}?[ \\t]*[=:](?!//))([^\\s\\x22\\x27&;,=<>(){{}}\\[\\]|?]{{{MIN_CHARS},}}={{0,2}})"
)
#: Characters of the transitions: letters 1 to 26, digits 27, signs 0, others 28.
_KIND = (
    "case when c between 'a' and 'z' then ascii(c) - 96 when c between '0' and '9' then 27 "
    "when ascii(c) < 128 then 0 else 28 end"
)
_KINDS = 29


def words_in(docs: DataFrame) -> DataFrame:
    """``word, docs``: words of 3 to 30 letters in lower case and how many documents have them.

    Words of at least ``MIN_DOCS`` documents, and of more than ``MAX_WORDS`` the
    most frequent ones.
    """
    letters = r"regexp_extract_all(lower(cast(text as string)), '\\p{L}{3,30}+', 0)"
    each = docs.select(F.explode(F.expr(f"array_distinct({letters})")).alias("word"))
    found = each.groupBy("word").agg(F.count("*").alias("docs")).where(f"docs >= {MIN_DOCS}")
    return found.orderBy(F.desc("docs"), "word").limit(MAX_WORDS)


def _places(word: str) -> str:
    """The two bits of a word."""
    return f"array(shiftrightunsigned(xxhash64({word}), {64 - BITS}), xxhash64({word}) & {(1 << BITS) - 1})"


def dictionary(words: DataFrame) -> Column:
    """The words as bits of an array of longs, read once as a subquery."""
    fixed = ", ".join(f"'{w}'" for w in DICTIONARY)
    all_ = words.select("word").union(words.sparkSession.sql(f"select explode(array({fixed}))"))
    bits = all_.selectExpr(f"explode({_places('word')}) as bit")
    longs = bits.groupBy(F.expr("shiftrightunsigned(bit, 6)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("long")
    )
    every = words.sparkSession.range(1 << (BITS - 6)).join(longs, F.expr("id = at"), "left")
    packed = F.expr("transform(array_sort(collect_list(struct(id, coalesce(long, 0L) as long))), x -> x.long)")
    return every.agg(packed).scalar()


def transitions(words: DataFrame) -> Column:
    """Log-probability of each kind of character after each other one, as an array."""
    kinds = f"transform(split(word, ''), c -> {_KIND})"
    pairs = words.selectExpr("docs", f"{kinds} as k").selectExpr(
        "docs", f"explode(transform(sequence(1, size(k) - 1), i -> k[i - 1] * {_KINDS} + k[i])) as pair"
    )
    counted = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    every = words.sparkSession.range(_KINDS * _KINDS).join(counted, F.expr("id = pair"), "left")
    row = every.selectExpr("id", f"id div {_KINDS} as one", "coalesce(n, 0) + 1D as n")
    logs = row.selectExpr("id", "ln(n / sum(n) over (partition by one)) as p")
    return logs.agg(F.expr("transform(array_sort(collect_list(struct(id, p))), x -> x.p)")).scalar()


def candidates(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``doc_id, word_no, value`` and the features of every candidate in every text.

    A candidate is a value of any length given to a name like 'password', or has
    ``MIN_CHARS`` characters and is a value given to another name, a quoted
    string or a run of characters; keys with a known prefix are found within
    others as well. A value may stand up to two words behind its name, and in
    quotes have up to twelve words, which then have one blank between them.
    ``word_no`` is the place of its first word, from 0; several candidates may
    share one. ``words`` are those of ``words_in`` (default: of ``docs``).

    A null text has none. Each of repeated rows has its own candidates; null ids
    stay. Other columns are not looked at; an empty table gives an empty one.
    """
    if words is None:
        words = written(words_in(docs), "secret-words")
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(cast(text as string), '') as text")
    cut = computed_once(
        rows.selectExpr("doc_id", f"text rlike '{_NAMED}' as _named", f"{words_of('text')} as _words")
    )
    ahead = "concat_ws(' ', right(get(_words, i - 2), 60), right(get(_words, i - 1), 60))"
    open_quote = r"_words[i] rlike '^[\\x22\\x27][^\\x22\\x27]*$'"
    found = cut.selectExpr(
        "doc_id",
        f"""transform(
            filter(if(size(_words) = 0, array(), sequence(0, size(_words) - 1)),
                   i -> length(_words[i]) >= {MIN_CHARS}
                   or (_named and (_words[i] rlike '{_NAMED}' or {ahead} rlike '{_NAMED_END}'))),
            i -> struct(i as word_no, _words[i] as word, {ahead} as ahead,
                        if(_named and {open_quote}, array_join(slice(_words, i + 1, 12), ' '), '') as quoted,
                        coalesce(left(get(_words, i + 1), 60), '') as behind)) as _found""",
    )
    each = computed_once(found.selectExpr("doc_id", "inline(_found)").selectExpr(
        "doc_id", "word_no", "ahead", "behind",
        f"regexp_extract(ahead, '{_NAMED_END}', 1) as _name",
        r"""coalesce(nullif(regexp_extract(quoted, '^(?:\\x22[^\\x22]*\\x22|\\x27[^\\x27]*\\x27)\\S*', 0), ''),
                     word) as word""",
    ))
    # A name that stands ahead is put to its value, where the patterns look for it.
    each = each.selectExpr(
        "doc_id", "word_no", "ahead", "behind", "if(_name <> '', concat(_name, '=', word), word) as word"
    )
    groups = ", ".join(f"regexp_extract_all(word, '{_PIECE}', {g})" for g in range(1, 7))
    pieces = computed_once(each.selectExpr(
        "*",
        f"arrays_zip({groups}) as _pieces",
        f"regexp_extract_all(word, '{_PREFIX}', 0) as _keys",
    ))
    # A name and a sign ahead of the value belong to the words beside it.
    valued = computed_once(pieces.selectExpr(
        "doc_id", "word_no", "ahead", "behind", "_keys",
        r"""transform(_pieces, p -> struct(p.`0` as name, if(p.`1` <> '', p.`1`, if(p.`2` <> '', p.`2`,
            if(p.`3` <> '', regexp_replace(p.`3`, '(?<![.:*`])[.:*`]++$', ''), if(p.`4` <> '', p.`4`,
            regexp_replace(p.`5`, '(?<![.;:,?!#*$%&|`])[.;:,?!#*$%&|`]++$', ''))))) as value)) as _values""",
    ))
    single = valued.selectExpr(
        "doc_id", "word_no", "ahead", "behind",
        """inline(concat(_values, transform(array_except(_keys, transform(_values, v -> v.value)),
                  k -> struct('' as name, k as value))))""",
    )
    secret_name = f"lower(name) rlike '{_SECRET_NAME}|^({_SHORT_NAME})$'"
    parts = single.where(
        f"value <> '' and (length(value) >= {MIN_CHARS} or {secret_name})"
    ).selectExpr(
        "doc_id", "cast(word_no as bigint) as word_no", "behind", "value",
        "lower(concat_ws(' ', ahead, name)) as ahead", "name <> '' as _named",
        f"cast({secret_name} as double) as named",
        f"cast(value rlike '^{_PREFIX}$' as double) as prefix",
    )
    share = lambda rx: f"regexp_count(value, '{rx}') / length(value)"
    changes = " + ".join(
        f"regexp_count(value, '[{a}](?=[{b}])')"
        for a in ("a-z", "A-Z", "0-9") for b in ("a-z", "A-Z", "0-9") if a != b
    )
    # Letters in a row, also where capitals begin a word within them.
    split_ = r"regexp_replace(value, '(\\p{Ll})(\\p{Lu})', '$1 $2')"
    letters = rf"regexp_extract_all(lower({split_}), '\\p{{L}}{{3,}}', 0)"
    read = parts.select("*", dictionary(words).alias("_bits"), transitions(words).alias("_logs"))
    read = computed_once(read.selectExpr(
        "*", f"transform(split(lower(value), ''), c -> {_KIND}) as _k", f"{letters} as _runs"
    ))
    known = f"forall({_places('w')}, b -> _bits[shiftright(b, 6)] & shiftleft(1L, cast(b & 63 as int)) <> 0)"
    return read.selectExpr(
        "doc_id", "word_no", "value",
        "cast(least(length(value), 200) as double) as length",
        f"cast(({changes}) / length(value) as double) as changes",
        f"""if(size(_k) < 2, 0D, aggregate(sequence(1, size(_k) - 1), 0D,
            (a, i) -> a + _logs[_k[i - 1] * {_KINDS} + _k[i]]) / (size(_k) - 1)) as usual""",
        f"{share('[0-9]')} as digits", f"{share('[A-Z]')} as upper", f"{share('[a-z]')} as lower",
        f"{share('[0-9a-f]')} as hex", f"{share('[^0-9A-Za-z]')} as signs",
        "size(array_distinct(split(value, ''))) / length(value) as variety",
        f"""aggregate(filter(_runs, w -> {known}), 0, (a, w) -> a + length(w))
            / length(value) as dictionary""",
        "cast(size(split(value, '[/@.:-]')) as double) as parts",
        "cast(value rlike '^[0-9.:/+-]+$' as double) as number",
        "cast(value rlike '@|://|^[./~]' as double) as place",
        f"cast(ahead rlike '{_KEYWORD}' as double) as keyword",
        f"cast(ahead rlike '{_PLAIN}' as double) as plain",
        "cast(_named or ahead rlike '[=:]\"?$' as double) as assigned",
        f"cast(lower(behind) rlike '{_KEYWORD}|{_PLAIN}' as double) as behind",
        "named", "prefix",
    )


FEATURES = (
    "length", "changes", "usual", "digits", "upper", "lower", "hex", "signs", "variety", "dictionary",
    "parts", "number", "place", "keyword", "plain", "assigned", "behind", "named", "prefix",
)


def told_by_rule(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` where a rule is certain: 1 for a secret, 0 for none, else null.

    A plain scanner to compare the forest with: keys with a known prefix
    and values given to a name like 'password' are secrets, also if they look
    like an address or a number; other addresses, plain numbers and versions are
    not.
    """
    return found.withColumn(
        "label",
        F.expr(
            r"""case when prefix = 1 then 1
                     when named = 1 and not value rlike '://|^[./~]'
                          and (digits > 0 or changes > 0.1 or signs > 0.1) then 1
                     when place = 1 or number = 1 then 0
                     when keyword = 1 and hex + upper + lower > 0.9 and digits > 0.1 then 1
                     when digits < 0.1 and changes < 0.1 then 0 end"""
        ),
    )


def scored(found: DataFrame, labelled: DataFrame, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """``found`` with ``score`` and ``secret``, by a forest fitted on ``labelled``.

    ``labelled`` has the features and ``label`` (1: a secret, 0: none, null: not
    used); of more than ``max_findings`` those with the lowest hashes train. If
    one of the two labels is missing nothing can be told apart: every candidate
    scores 1.
    """
    some = labelled.where("label in (0, 1)").orderBy(
        F.xxhash64("doc_id", "word_no", "value"), "doc_id", "word_no", "value"
    )
    train = written(
        some.limit(max_findings).selectExpr(*FEATURES, "cast(label as double) as label"),
        "secret-findings",
    )
    if train.select("label").distinct().count() < 2:
        return found.selectExpr("*", "1D as score", "true as secret")
    gathered = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
        probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted",
    ).fit(gathered.transform(train))
    made = forest.transform(gathered.transform(found))
    return made.select(
        *found.columns, vector_to_array("_probability")[1].alias("score")
    ).withColumn("secret", F.col("score") >= THRESHOLD)


def planted(spark: SparkSession, words: DataFrame, n: int = PLANTED) -> DataFrame:
    """``doc_id, text, planted, label``: one finding in each text, made here and so labelled.

    Secrets are random keys in several alphabets, keys with known prefixes and
    passwords. What isn't secret is words of ``words`` joined in several ways,
    paths, mail addresses, numbers, digests beside names of digests, and what
    stands for a password where none is given. Both stand behind the same names
    and signs, or behind none, so that it takes the value and the words beside
    it to tell them apart.
    """
    fixed = ", ".join(f"'{w}'" for w in DICTIONARY)
    top = words.orderBy(F.desc("docs"), "word").limit(5000).agg(F.expr("array_sort(collect_list(word))"))
    w = lambda k: f"_w[pmod(xxhash64(id, 'w{k}'), size(_w))]"
    of = lambda k, *xs: f"element_at(array({', '.join(xs)}), cast(1 + pmod(xxhash64(id, '{k}'), {len(xs)}) as int))"
    up_to = lambda k, low, high: f"cast({low} + pmod(xxhash64(id, '{k}'), {high - low + 1}) as int)"
    made = spark.range(n).select("id", F.concat(top.scalar(), F.expr(f"array({fixed})")).alias("_w"))
    made = made.selectExpr(
        "*", "sha2(concat('a', id), 256) as _hex",
        "base64(unhex(concat(sha2(concat('b', id), 256), sha2(concat('c', id), 256)))) as _b64",
        "lpad(cast(pmod(xxhash64(id, 'n'), 1000000000000000000) as string), 18, '7') as _num",
    ).selectExpr("*", "regexp_replace(_b64, '[+/=]', '') as _b62")
    key_names = of("k", *(f"'{x}'" for x in (
        "token", "secret", "password", "api_key", "access_key", "client_secret", "auth_token", "pwd")))
    other_names = of("o", *(f"'{x}'" for x in ("name", "id", "path", "title", "url", "value", "user", "file", "key")))
    digest_names = of("d", *(f"'{x}'" for x in ("commit", "sha", "uuid", "checksum", "version", "sha256", "serial")))
    word_value = of(
        "wv", f"concat({w(1)}, '-', {w(2)}, '-', {w(3)})", f"concat({w(1)}, '_', {w(2)}, '_', {w(3)})",
        f"concat({w(1)}, initcap({w(2)}), initcap({w(3)}))", f"concat({w(1)}, {w(2)}, {w(3)})",
        f"concat({w(1)}, '.', {w(2)}, '.', {w(3)}, '()')", f"concat(initcap({w(1)}), '-', {w(2)}, '-2.', id % 9)",
        f"upper(concat({w(1)}, {w(2)}, {w(3)}))", f"initcap(concat({w(1)}, {w(2)}, {w(3)}))",
        f"concat({w(1)}, {w(2)}, {w(3)}, '###')",
    )
    place_value = of(
        "pv", f"concat('/', {w(1)}, '/', {w(2)}, '/', {w(3)}, '.txt')",
        f"concat('https://', {w(1)}, '.com/', {w(2)}, '/', {w(3)}, '?', {w(4)}, '=', id)",
        f"concat({w(1)}, '.', {w(2)}, id % 100, '@', {w(3)}, '.com')",
        f"concat('../', {w(1)}, {w(2)}, '/', {w(3)}, '.', {w(4)})",
    )
    number_value = of(
        "nv", "left(_num, 12 + id % 6)", "concat(id % 256, '.', id % 199, '.', id % 251, '.', 100 + id % 100, ':8080')",
        "concat('20', 10 + id % 15, '-0', 1 + id % 9, '-1', id % 9, 'T1', id % 9, ':00:0', id % 9)",
        "concat('+49-', left(_num, 3), '-', substring(_num, 4, 7))",
    )
    stand_in = of(
        "sv", "'changeme'", f"concat('your-', {w(1)}, '-here')", "'xxxxxxxxxxxx'", "'************'",
        f"concat('env.', upper({w(1)}), '_', upper({w(2)}))", f"concat('get_', {w(1)}, '_', {w(2)}, '()')",
        f"concat({w(1)}, {w(2)})", "'undefined'", "'123456'", f"concat('<', {w(1)}, '-', {w(2)}, '>')",
    )
    key_value = of(
        "kv", f"left(_hex, {up_to('l1', 20, 64)})", f"left(_b62, {up_to('l2', 16, 40)})",
        f"concat(left(_b64, {up_to('l3', 22, 60)}), '==')", f"left(upper(_b62), {up_to('l4', 16, 32)})",
        f"left(lower(_b62), {up_to('l5', 16, 32)})", "left(_hex, 40)",
    )
    prefixed = of("pf", "concat('AKIA', left(upper(_b62), 16))", "concat('ghp_', left(_b62, 36))",
                  "concat('xoxb-', left(_b62, 24))", "concat('sk_live_', left(_b62, 24))")
    password = of(
        "pw", f"concat(initcap({w(1)}), id % 1000, '!')", "left(_b62, 9)", f"concat({w(1)}, '#', id % 100, left(_b62, 3))",
        f"concat('P@', {w(1)}, left(_num, 4))", f"left(_b62, {up_to('l6', 8, 14)})",
    )
    # kind: name, value, label
    kinds = [
        (key_names, key_value, 1), (other_names, key_value, 1), ("''", key_value, 1),
        (key_names, prefixed, 1), ("''", prefixed, 1), (key_names, password, 1),
        (key_names, stand_in, 0), (key_names, word_value, 0), (other_names, word_value, 0),
        ("''", word_value, 0), (key_names, place_value, 0), (other_names, place_value, 0),
        ("''", number_value, 0), (digest_names, number_value, 0), (digest_names, "_hex", 0),
        (digest_names, "left(_hex, 40)", 0),
    ]
    kind = f"pmod(xxhash64(id, 'kind'), {len(kinds)})"
    case = lambda at: "case " + kind + "".join(f" when {i} then {k[at]}" for i, k in enumerate(kinds)) + " end"
    sign = of("sign", "' = '", "'='", "': '", "':'")
    quote = of("quote", "''", "'\"'", "'\"'")
    behind = of("behind", w(5), "'and'", f"concat({w(5)}, '.')")
    return made.selectExpr(
        "id", "_w", f"{case(0)} as _name", f"{case(1)} as planted", f"{case(2)} as label"
    ).selectExpr(
        "id as doc_id", "planted", "label",
        f"concat({w(6)}, ' ', {w(7)}, ' ', if(_name = '', planted, concat(_name, {sign}, {quote}, planted, {quote})),"
        f" ' ', {behind}, ' ', {w(8)}) as text",
    )


def planted_findings(spark: SparkSession, words: DataFrame, n: int = PLANTED) -> DataFrame:
    """The candidates of planted texts with their labels, found as in any text."""
    texts = written(planted(spark, words, n), "secret-planted")
    found = candidates(texts, words)
    told = texts.select(F.col("doc_id").alias("_d"), "planted", "label")
    same = F.expr("doc_id = _d and instr(planted, value) > 0")
    return found.join(told, same).drop("_d", "planted")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs`` with features, ``score`` and ``secret``.

    Without ``labelled`` findings (candidates with ``label``) those train that are
    planted into texts of the corpus's own words.
    """
    words = written(words_in(docs), "secret-words")
    found = written(candidates(docs, words), "secret-candidates")
    if labelled is None:
        labelled = planted_findings(docs.sparkSession, words)
    return scored(found, labelled)
