"""Training-data operators: de-duplication, fingerprints, chat formatting,
toxicity, decontamination, secrets, token counts, token files, quality and
source mixing. Nothing outside this subpackage imports it."""
