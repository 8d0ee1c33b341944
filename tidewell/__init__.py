"""tidewell: a PySpark-native engine for listings, vacancies and candidates."""
