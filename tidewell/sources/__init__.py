"""tidewell.sources"""
