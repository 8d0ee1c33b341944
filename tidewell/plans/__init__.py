"""tidewell.plans"""
