"""Normalisers of names and texts. They differ on purpose; joins depend on each."""

from ..operators.browse import unambiguous
from ..operators.curation import norm_words, slug
from ..operators.graph import norm_chem
from ..operators.identity import author_key, journal_key, norm_mvl, norm_synonym
from ..operators.retrieval import dot
from ..sources.files import normalise_doi

__all__ = ["author_key", "dot", "journal_key", "norm_chem", "norm_mvl", "norm_synonym", "norm_words", "normalise_doi", "slug", "unambiguous"]
