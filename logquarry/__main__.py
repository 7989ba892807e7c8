from logquarry.cli import main

raise SystemExit(main())
