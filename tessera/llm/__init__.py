"""Training-data operators on Spark: deduplication, decontamination, extraction,
scanning, formatting, sharding and packing.  Nothing else in the library imports this."""
