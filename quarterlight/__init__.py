"""A Spark-native engine for company filings: reading, classifying, extracting,
merging, validating, cataloguing and tracking, as lazy DataFrame plans."""
