"""webloom: site-crawl analytics and corpus preparation as Spark DataFrame operators."""
