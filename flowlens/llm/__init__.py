"""Training-data operators: decontamination, language, toxicity, secrets,
mixing, token counts, chat logs, language-model scores and near-duplicates.

Nothing else in the library imports this subpackage.
"""
