"""Training-data operators: deduplication, quality, language, toxicity, licences, tokens, decontamination."""
