"""Advertiser intelligence over paged publications, as DataFrame operators on Spark."""
