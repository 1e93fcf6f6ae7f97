"""Column expressions over text. All of them stay inside the JVM."""

from pyspark.sql import functions as F

# What counts as a token, a citation and white space.
TOKEN_PATTERN = "[a-z0-9]+"
CITATION_PATTERN = r"\[([A-Za-z0-9][A-Za-z0-9\-_.]*)\]"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Words taken out of a question before the lexical lane sees it.
FUNCTION_WORDS = """
a an and are as at be been being but by can could did do does doing for from
had has have having how in into is it its of on or our the their this that
these those to was were what when where which who whom whose why will with
would you your about above after again against am any because before below
between both during each few further here if more most no nor not only other
over own same so some such than then there through under until up very
""".split()
REPORTING_WORDS = """
say says said tell tells told describe describes described disclose discloses
disclosed mention mentions mentioned state states stated report reports
reported discuss discusses discussed explain explains explained
""".split()
QUERY_STOP_WORDS = FUNCTION_WORDS + REPORTING_WORDS


def strip(text):
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def let(value, body):
    """``body(value)`` with the value worked out once, for use in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text):
    """Lower-case alphanumeric runs, in order, repeats kept, no stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def informative_tokens(question):
    """Question tokens less the stop words, possibly none."""
    return F.filter(tokens(question), lambda t: ~t.isin(QUERY_STOP_WORDS))


def lexical_tokens(question):
    """What the lexical lane searches for: never empty unless the question is."""
    kept = informative_tokens(question)
    return F.when(F.size(kept) > 0, kept).otherwise(tokens(question))


def one_line(text, joiner=" "):
    return F.replace(text, F.lit("\n"), F.lit(joiner))


def preview(text):
    """First 200 characters, cut at the last space if one falls late enough."""
    head = F.substring(text, 1, 200)
    late_space = F.contains(F.substring(head, 161, 40), F.lit(" "))
    cut = F.when(late_space, F.regexp_extract(head, r"(?s)\A(.*) ", 1)).otherwise(head)
    return one_line(cut, " | ")


def excerpt(text, chars):
    """Stripped, flattened to one line, then shortened."""
    return F.substring(one_line(strip(text)), 1, chars)


def short_id(chunk_id):
    return F.element_at(F.split(chunk_id, "-"), -1)


def id_company(chunk_id, companies):
    """Display name for an id's ticker prefix; unknown tickers stay as they are."""
    ticker = F.split_part(chunk_id, F.lit("-"), F.lit(1))
    name = ticker
    for symbol, names in companies.items():
        name = F.when(ticker == symbol, F.lit(names[0])).otherwise(name)
    return name


def filter_mismatch(company, mentioned):
    """A filter is set, companies are named, and the filter is not among them."""
    return F.coalesce(
        (F.size(mentioned) > 0) & ~F.array_contains(mentioned, F.upper(company)), F.lit(False)
    )


# Lower edge and label of each similarity band.
CONFIDENCE_BANDS = [
    (0.75, "very high (direct paraphrase)"),
    (0.65, "high (clearly relevant)"),
    (0.58, "moderate (likely relevant)"),
    (0.52, "low (near BGE noise floor — corpus may not contain a good match)"),
]
LOWEST_BAND = "very low (likely no good match)"


def confidence_label(similarity):
    label = F.lit(LOWEST_BAND)
    for edge, text in reversed(CONFIDENCE_BANDS):
        label = F.when(similarity >= edge, F.lit(text)).otherwise(label)
    return label


def refusal_band(similarity, settings):
    return (
        F.when(similarity < settings.refuse_floor, "refuse")
        .when(similarity < settings.refuse_grey, "weak")
        .otherwise("answer")
    )


def citations(answer):
    """Distinct bracketed ids, sorted."""
    return F.array_sort(
        F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION_PATTERN), F.lit(1)))
    )


def similarity_bar(similarity):
    return F.repeat(F.lit("#"), F.greatest(F.bround(similarity * 40).cast("int"), F.lit(0)))
