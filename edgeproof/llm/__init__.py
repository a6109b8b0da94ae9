"""Training-data operators: mixing, near duplicates, decontamination, secrets, scoring, packing.

Nothing outside this folder imports it; the entry module adds its queries when it is present.
"""
