"""Wording labellers: lexicons of abuse by language, matched on whole words and rated by word and by sentence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import byte_blocks, frugal

# Words that belittle a person, and words that do so beside a plain meaning.
INSULTS = {
    "en": "idiot idiots idiotic moron morons moronic imbecile imbeciles cretin cretins dumbass dumbasses jackass asshole assholes bastard bastards bitch bitches slut sluts whore whores scum scumbag scumbags loser losers stupid dumb retard retards retarded pathetic worthless despicable dimwit dimwits halfwit halfwits nitwit nitwits douchebag douchebags prick pricks wanker wankers twat twats degenerate degenerates lowlife lowlifes fuck fucker fuckers fucking motherfucker motherfuckers bullshit",
    "de": "idiot idioten idiotin idiotisch trottel depp deppen vollidiot vollidioten arschloch arschlöcher schlampe schlampen hure huren hurensohn hurensöhne wichser fotze mistkerl mistkerle drecksack dreckskerl abschaum versager versagerin blödmann dummkopf dummköpfe schwachkopf schwachköpfe missgeburt missgeburten spast spasti penner widerling erbärmlich erbärmlicher erbärmliche wertlos wertloser wertlose",
    "fr": "idiot idiots idiote idiotes imbécile imbéciles crétin crétins crétine abruti abrutis abrutie débile débiles connard connards connasse connasses salaud salauds salope salopes pute putes putain enculé enculés enfoiré enfoirés ordure ordures minable minables merdeux racaille racailles bouffon bouffons tocard tocards pourriture pourritures stupide stupides pathétique pathétiques",
    "es": "idiota idiotas imbécil imbéciles estúpido estúpidos estúpida estúpidas cretino cretinos cretina gilipollas cabrón cabrones pendejo pendejos pendeja puta putas puto putos zorra zorras escoria malnacido malnacidos tarado tarados tarada retrasado retrasados inútil inútiles perdedor perdedores patético patética patéticos miserable miserables hijoputa mamón mamones subnormal subnormales",
}
SLIGHTS = {
    "en": "trash garbage clown clowns disgusting filthy vermin parasite parasites freak freaks creep creeps coward cowards crap shit shitty hideous repulsive pig pigs rat rats",
    "de": "müll dreck clown clowns widerlich widerliche widerlicher ekelhaft ekelhafte ekelhafter ungeziefer parasit parasiten feigling feiglinge schwein schweine ratte ratten dumm dumme dummer blöd blöde scheiße scheiß",
    "fr": "clown clowns dégoûtant dégoûtante dégueulasse dégueulasses vermine parasite parasites lâche lâches porc porcs rat rats merde nul nulle raté ratés",
    "es": "basura payaso payasos asqueroso asquerosa asquerosos alimaña alimañas parásito parásitos cobarde cobardes cerdo cerdos rata ratas mierda tonto tonta tontos",
}
VOTES = ("v_abuse", "v_kinds", "v_insulted")
_STEP = np.uint64(0x100000001B3)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, sentence) of each word: a run of letters of any script, lower-cased in ASCII and Latin-1. Sentences are numbered over all rows."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    before, after = np.append(np.uint8(0), data[:-1]), np.append(data[1:], np.uint8(0))
    latin = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low = np.where(((data >= 65) & (data <= 90)) | latin, data + 32, data).astype(np.uint64)
    letter = ((low >= 97) & (low <= 122)) | (data >= 0x80)
    sign = np.flatnonzero((data == 0xE2) & (after == 0x80))  # dashes, quotes and the like
    for k in range(3):
        letter[np.minimum(sign + k, size - 1)] = False
    letter[np.flatnonzero((data == 0xC2) | (before == 0xC2))] = False  # no-break spaces, guillemets, inverted marks
    first = np.zeros(size, bool)
    first[offsets[:-1][offsets[:-1] < size]] = True
    start = letter & (first | ~np.append(False, letter[:-1]))
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.where(letter, np.arange(size) - np.maximum.accumulate(np.where(start, np.arange(size), 0)), 0)
    power = np.cumprod(np.full(int(place.max()) + 1, _STEP, np.uint64))
    code = np.add.reduceat(np.where(letter, (low + np.uint64(1)) * power[place], np.uint64(0)), at)
    ends = (data == 46) | (data == 33) | (data == 63) | (data == 10)
    row = np.searchsorted(offsets, at, "right") - 1
    return row, code, np.cumsum(ends | first)[at]


def _codes(lists: dict[str, str]) -> np.ndarray:
    data = "\n".join(sorted({w for x in lists.values() for w in x.split()})).encode()
    return np.unique(words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1])


_INSULTS = _codes(INSULTS)
_ALL = np.union1d(_INSULTS, _codes(SLIGHTS))


def counts(found: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int) -> dict[str, np.ndarray]:
    """Per row: words, lexicon words, distinct ones, sentences, and sentences with an insult."""
    row, code, sentence = found
    hit = np.isin(code, _ALL)
    kinds = np.unique(np.stack([row[hit].astype(np.uint64), code[hit]]), axis=1)[0].astype(np.int64)
    count = lambda r: np.bincount(r, minlength=rows)
    each = lambda keep: count(row[keep][np.unique(sentence[keep], return_index=True)[1]])
    return {"words": count(row), "hits": count(row[hit]), "kinds": count(kinds), "sentences": each(np.ones(len(row), bool)), "insulted": each(np.isin(code, _INSULTS))}


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x VOTES: 1 for clean wording, -1 for abuse, 0 for an abstention. One such word alone is no abuse."""
    share = c["hits"] / np.maximum(c["words"], 1)
    insulted = c["insulted"] / np.maximum(c["sentences"], 1)
    vote = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    return np.stack(
        [
            vote((share > 0.005) & (c["hits"] > 1), (share < 0.001) | (c["hits"] < 2)),
            vote((c["kinds"] > 1) & (share > 0.002), c["kinds"] < 2),
            vote((insulted > 0.05) & (c["insulted"] > 1), (insulted < 0.01) | (c["insulted"] < 2)),
        ],
        axis=1,
    )


def level(c: dict[str, np.ndarray]) -> np.ndarray:
    """0 to 7: how dense abuse by at least two different words is."""
    share = c["hits"] / np.maximum(c["words"], 1)
    return np.where(c["kinds"] < 2, 0, np.clip(np.log2(1e-6 + share * 1000) + 2, 1, 7)).astype(int)


def voted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The votes on the wording of each whole text."""

    def run(batches):
        frugal()
        for batch in batches:
            for _, _, data, offsets in byte_blocks(batch.column(0), 1 << 18, 64):
                cast = votes(counts(words(data, offsets), len(offsets) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in cast.T], list(VOTES))

    return docs.select(text_col).mapInArrow(run, ", ".join(f"{v} int" for v in VOTES))
