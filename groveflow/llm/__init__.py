"""Training-data operators: decontamination, licences, fingerprints, deduplication, filters, language, PII, BPE, LM scores."""
