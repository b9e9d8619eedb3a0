"""Where the small tables of the tests are."""

SF = "/root/testdata/sf0.001"
