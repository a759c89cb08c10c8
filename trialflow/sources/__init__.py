"""Reading raw files under explicit schemas; reading and writing catalog tables."""
