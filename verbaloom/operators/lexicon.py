"""The small closed-class tables of the rule annotator.

They are a baseline, not a dictionary: function words of four languages, the usual
contractions and a few names.  Pass your own ``Lexicon`` to the rule annotator to extend
them, or use a plug-in annotator for model-quality analysis.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# language -> tag -> "form=lemma" entries, the most frequent words first.
CLOSED_CLASS = {
    "en": {
        "DET": "the=the a=a an=a this=this that=that",
        "ADP": "of=of in=in to=to for=for on=on with=with at=at by=by from=from",
        "CCONJ": "and=and or=or but=but",
        "SCONJ": "if=if because=because",
        "PRON": "it=it he=he she=she they=they we=we i=i you=you",
        "AUX": "is=be are=be was=be were=be be=be will=will can=can",
        "PART": "not=not",
        "VERB": "have=have has=have said=say came=come goes=go",
    },
    "es": {
        "DET": "el=el la=el los=el las=el un=uno una=uno",
        "ADP": "de=de en=en a=a con=con por=por para=para sobre=sobre",
        "CCONJ": "y=y o=o",
        "SCONJ": "que=que porque=porque",
        "PRON": "se=él nos=yo yo=yo ella=él",
        "AUX": "es=ser son=ser fue=ser está=estar",
        "ADV": "no=no ayer=ayer muy=mucho",
        "VERB": "voy=ir ve=ver come=comer llegó=llegar tiene=tener",
    },
    "fr": {
        "DET": "le=le la=le les=le un=un une=un",
        "ADP": "de=de à=à en=en dans=dans par=par pour=pour avec=avec sur=sur",
        "CCONJ": "et=et ou=ou mais=mais",
        "SCONJ": "que=que si=si",
        "PRON": "il=il elle=il on=on qui=qui",
        "AUX": "est=être sont=être",
        "ADV": "ne=ne pas=pas",
        "VERB": "a=avoir ont=avoir fait=faire va=aller",
    },
    "de": {
        "DET": "der=der die=der das=der den=der dem=der ein=ein eine=ein",
        "ADP": "in=in zu=zu von=von mit=mit an=an auf=auf bei=bei für=für",
        "CCONJ": "und=und oder=oder aber=aber",
        "SCONJ": "dass=dass weil=weil",
        "PRON": "er=er sie=sie es=es ich=ich",
        "AUX": "ist=sein sind=sein war=sein wird=werden",
        "PART": "nicht=nicht",
        "VERB": "hat=haben geht=gehen sagt=sagen",
    },
}

# language -> "token=first+second" contractions.
CONTRACTIONS = {
    "en": "cannot=can+not",
    "es": "del=de+el al=a+el",
    "fr": "des=de+les du=de+le aux=à+les au=à+le",
    "de": "im=in+dem zum=zu+dem zur=zu+der vom=von+dem am=an+dem ins=in+das beim=bei+dem",
}

# type -> names in lower case.
NAMES = {
    "PER": ["maría", "maria", "josé", "anna", "paul"],
    "LOC": ["buenos aires", "madrid", "paris", "berlin", "london"],
    "ORG": ["unesco", "nato"],
}


def _default_tags() -> dict[tuple[str, str], tuple[str, str]]:
    table: dict[tuple[str, str], tuple[str, str]] = {}
    for lang, by_tag in CLOSED_CLASS.items():
        for tag, entries in by_tag.items():
            for entry in entries.split():
                form, lemma = entry.split("=")
                table.setdefault((lang, form), (lemma, tag))
    return table


def _default_contractions() -> dict[tuple[str, str], list[str]]:
    return {
        (lang, token): words.split("+")
        for lang, entries in CONTRACTIONS.items()
        for token, words in (entry.split("=") for entry in entries.split())
    }


def _default_names() -> dict[str, str]:
    return {name: kind for kind, names in NAMES.items() for name in names}


@dataclass(frozen=True)
class Lexicon:
    """Tables of the rule annotator; forms, tokens and names are in lower case."""

    tags: dict[tuple[str, str], tuple[str, str]] = field(default_factory=_default_tags)
    contractions: dict[tuple[str, str], list[str]] = field(default_factory=_default_contractions)
    names: dict[str, str] = field(default_factory=_default_names)
