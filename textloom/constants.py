"""Patterns, word lists and codes that define the results. Fixed values throughout, stated plainly."""

from __future__ import annotations

import re

# White space and the characters that normalising deletes, as members of a character class (Java syntax).
SPACE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
DELETED = r"\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{FFFC}\x{FFFD}\x{00}-\x{08}\x{0E}-\x{1F}"
#: Characters that are neither, save the space and the line feed (control characters from 7F on are left out); printable ASCII stands first, since classes are tried in order.
PLAIN = r"[ -~[\n\x{A1}-\x{AC}\x{AE}-\x{167F}\x{1681}-\x{1FFF}\x{200E}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2061}-\x{2FFF}\x{3001}-\x{FEFE}\x{FF00}-\x{FFFB}\x{10000}-\x{10FFFF}]]"
# A word, for Java (possessive, so long words neither backtrack nor recurse) and for RE2.
WORD = r"[\p{L}\p{M}\p{N}]++(?:(?:['’ʼ\-‐‑]|[.,](?=\p{N}))[\p{L}\p{M}\p{N}]++)*+"
WORD_RE2 = r"[\p{L}\p{M}\p{N}]+(?:['’ʼ\-‐‑][\p{L}\p{M}\p{N}]+|[.,]\p{N}[\p{L}\p{M}\p{N}]*)*"
RUN = r"[\p{L}\p{N}]+"

# Words whose 's is a contraction.
CONTRACTION_HOSTS = "it he she that this there here what where who how when why let".split()

CLASSES = "nouns verbs adjectives adverbs pronouns determiners articles prepositions conjunctions interjections numbers other".split()
FUNCTION_CLASSES = "articles pronouns determiners prepositions conjunctions interjections".split()

# English function words. A word belongs to the first class that lists it.
ENGLISH = {
    "articles": "a an the",
    "pronouns": """i me my mine myself you your yours yourself yourselves he him his himself she her hers herself
        it its itself we us our ours ourselves they them their theirs themselves
        who whom whose which what whoever whomever whatever whichever that
        anybody anyone anything everybody everyone everything nobody none nothing
        somebody someone something oneself thee thou thy thine ye y'all
        i'm i've i'd i'll you're you've you'd you'll he's he'd he'll she's she'd she'll
        it's it'd it'll we're we've we'd we'll they're they've they'd they'll
        that's that'll that'd who's who'd who'll who've what's what'd what'll
        there's here's somebody's someone's everybody's everyone's nobody's""",
    "determiners": """this these those each every either neither some any no all both few fewer
        many much more most several enough such other another little less least
        certain various whichever whatsoever""",
    "prepositions": """about above across after against along alongside amid amidst among amongst around aboard atop
        at before behind below beneath beside besides between beyond by circa concerning considering
        despite down during except excepting excluding following for from in including inside into
        near nearer nearest notwithstanding of off on onto opposite out outside over per regarding
        since through throughout till to toward towards under underneath unlike until unto up upon
        versus via with within without vs thru amongst o'er 'til""",
    "conjunctions": """and but or nor so yet although though because unless whereas while whilst if whether
        than as lest once provided providing whenever wherever whereby albeit""",
    "interjections": """oh ah aha ahh alas hey hi hello wow ouch oops uh um umm er erm hmm hm huh yeah yes
        okay ok ugh phew hurray hooray hurrah bravo eh gosh ooh oo shh shush whoa yay yikes
        bye goodbye ahem aw aww darn gee ha haha hah mm mmm nah nope yep yup oy ow psst ahoy boo
        bingo egad golly hallelujah amen eek jeez meh voila wham yo hush pshaw blah bah tut""",
}
# Spanish function words.
SPANISH = {
    "articles": "el la los las lo un una unos unas",
    "pronouns": """yo tú él ella ello nosotros nosotras vosotros vosotras ellos ellas usted ustedes vos
        me te se nos os le les mí ti conmigo contigo consigo
        mi mis tu tus su sus mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas
        nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras
        quien quienes quién quiénes cual cuales cuál cuáles qué cuyo cuya cuyos cuyas
        alguien nadie algo nada esto eso aquello cualquiera quienquiera""",
    "determiners": """este esta estos estas ese esa esos esas aquel aquella aquellos aquellas
        algún alguno alguna algunos algunas ningún ninguno ninguna ningunos ningunas
        cada todo toda todos todas otro otra otros otras mucho mucha muchos muchas
        poco poca pocos pocas varios varias tanto tanta tantos tantas bastante bastantes
        demasiado demasiada demasiados demasiadas cierto cierta ciertos ciertas ambos ambas
        cuanto cuanta cuantos cuantas cuánto cuánta cuántos cuántas más menos
        mismo misma mismos mismas tal tales sendos sendas cualesquiera""",
    "prepositions": """a ante bajo cabe con contra de desde durante en entre hacia hasta mediante
        para por según sin so sobre tras versus vía excepto salvo al del""",
    "conjunctions": """y e ni o u pero sino mas aunque porque pues que si mientras conque como
        cuando donde siquiera""",
    "interjections": """ah ay oh eh uf ojalá hola adiós olé bah huy uy caramba caray hala ea guau
        ja jaja jajaja bravo ejem hurra puaj puf ush chist chitón ey buah sí""",
}
# Number words.
NUMBERS_ENGLISH = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
    sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety
    hundred thousand million billion trillion dozen
    zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth
    thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth
    fortieth fiftieth sixtieth seventieth eightieth ninetieth hundredth thousandth millionth billionth trillionth
    hundreds thousands millions billions dozens"""
NUMBERS_SPANISH = """cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince
    dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintiún veintiuna veintidós veintitrés veinticuatro
    veinticinco veintiséis veintisiete veintiocho veintinueve treinta cuarenta cincuenta sesenta setenta ochenta
    noventa cien ciento cientos doscientos doscientas trescientos trescientas cuatrocientos cuatrocientas quinientos
    quinientas seiscientos seiscientas setecientos setecientas ochocientos ochocientas novecientos novecientas
    mil miles millón millones billón billones docena docenas primer tercer"""
ORDINAL_STEMS_SPANISH = """primer segund tercer cuart quint sext séptim octav noven décim undécim duodécim
    vigésim trigésim cuadragésim quincuagésim sexagésim septuagésim octogésim nonagésim centésim milésim millonésim"""
NUMERAL = r"\A\p{N}[\p{N}.,]*(?:st|nd|rd|th|s|º|ª|\.º|\.ª|er|ro|ra|do|da|to|ta|vo|va|no|na|mo|ma)?\z"

# Chapter titles, titles of tables of contents and of indexes. Ends of words are ASCII ones.
CHAPTER = (
    r"^(?:chapter|chap\.|part|book|volume|vol\.|section|prologue|epilogue|introduction|preface|foreword|afterword|acknowledge?ments?|appendix|interlude|conclusion|dedication|about the author|"
    r"cap[ií]tulo|chapitre|kapitel|parte|libro|pr[oó]logo|ep[ií]logo|introducci[oó]n|avant-propos)"
)
TOC_TITLE = r"^(?:table of contents|contents|content|toc|[íi]ndice|sumario|sommaire|table des mati[eè]res|inhalt|inhaltsverzeichnis|indice|sum[aá]rio)[:.]?$"
INDEX_TITLE = r"^(?:index|general index|subject index|index of names|[íi]ndice (?:alfab[eé]tico|anal[ií]tico)|index alphab[eé]tique|register)[:.]?$"
#: Every mark below holds one of these in lower case, so most texts need no search for each.
COPYRIGHT_HINTS = ("©", "(c)", "copyright", "reserv", "réserv", "isbn", "publish", "first", "printed", "library", "catalog", "no part", "cover", "typeset", "imprint", "edition", "permission", "fictitious", "coincidental", "resemblance", "dep")
COPYRIGHT_HINT = "|".join(map(re.escape, COPYRIGHT_HINTS))
# Marks of a copyright page; \b stands for an ASCII word boundary.
COPYRIGHT_MARKS = (
    r"©",
    r"\(c\)\s*(?:19|20)\d\d",
    r"\bcopyright\b",
    r"all rights reserved|todos los derechos reservados|tous droits r[eé]serv[eé]s",
    r"\bisbn\b",
    r"\bpublished (?:by|in)\b",
    r"\bfirst (?:published|edition|printing)\b",
    r"\bprinted in\b",
    r"library of congress|cataloging|catalogu(?:e|ing) record|british library",
    r"no part of this (?:book|publication|work)",
    r"\bcover (?:design|art|image|illustration)\b",
    r"\btypeset\b",
    r"\bimprint\b",
    r"\bedition\b",
    r"\bwithout (?:the )?(?:prior )?(?:written )?permission\b",
    r"\bfictitious|coincidental|resemblance to actual persons\b",
    r"\bpublisher\b",
    r"\bdep[oó]sito legal\b",
)

# Error and warning codes.
ERRORS = "generic notFound cannotOpen encrypted kfx kfxZip topaz badKindle notZip badPdf docNot97 unsupported zipDamaged zipUnknown pdfPassword pdfOpen kindleDrm kindleCompression kindleEmpty docDamaged docPassword docNotWord docTooOld epubNoOpf epubAdobeDrm epubDrm pagesNoText ibaNoText workerStopped timeout workerCrashed".split()
WARNINGS = "pdfNoText noText iworkNoBody pagesBestEffort ibaBestEffort".split()

READING_WPM, WPM_LEAST, WPM_MOST = 238, 50, 2000
LANGUAGE_TOKENS, FIND_LIMIT = 20_000, 5_000


def word_list(text: str) -> list[str]:
    return list(dict.fromkeys(text.split()))


def function_words(language: str) -> dict[str, str]:
    """Word to class; the first class that lists a word counts."""
    lists = SPANISH if language == "es" else ENGLISH
    out: dict[str, str] = {}
    for cls in FUNCTION_CLASSES:
        for word in word_list(lists[cls]):
            out.setdefault(word, cls)
    return out


def number_words(language: str) -> list[str]:
    if language != "es":
        return word_list(NUMBERS_ENGLISH)
    return word_list(NUMBERS_SPANISH) + [stem + end for stem in word_list(ORDINAL_STEMS_SPANISH) for end in ("o", "a", "os", "as")]


_NOT_WORD_BEFORE, _NOT_WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def ascii_bounds(pattern: str) -> str:
    r"""Java's ``\b`` follows Unicode; write it out as the ASCII boundary, by what stands next to it."""
    out, i = "", 0
    while (at := pattern.find(r"\b", i)) >= 0:
        out += pattern[i:at]
        out += _NOT_WORD_BEFORE if at + 2 < len(pattern) and (at == 0 or pattern[at - 1] in "|(") else _NOT_WORD_AFTER
        i = at + 2
    return out + pattern[i:]
